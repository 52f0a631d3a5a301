"""Command line: analyze (or check), profile, version, help."""

from __future__ import annotations

import argparse
import os
import re
import sys
from dataclasses import replace
from datetime import datetime
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from tidegauge.operators.classes import load
from tidegauge.plans import render, store
from tidegauge.plans.findings import at_least, worst
from tidegauge.plans.profile import ProfileError, ProfileOptions
from tidegauge.plans.profile import build as build_profile
from tidegauge.plans.report import TOOL, Options, analyze

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "us": 0.001, "µs": 0.001, "ns": 0.000001}
_TIMES = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d")


def duration_ms(text: str) -> int:
    """``1s``, ``500ms``, ``1m30s`` as whole milliseconds."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|µs|ns|s|m|h)", text.strip())
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise argparse.ArgumentTypeError(f"{text!r} is no duration (try 500ms or 7s)")
    return int(sum(float(a) * _UNITS[b] for a, b in parts))


def instant(text: str, zone: str) -> datetime | None:
    """A window bound: RFC 3339, or a time in the log's zone."""
    if not text.strip():
        return None
    tz = ZoneInfo(zone)
    if re.search(r"T.*(Z|[+-]\d\d:\d\d)$", text.strip()):
        return datetime.fromisoformat(text.strip())
    for form in _TIMES:
        try:
            return datetime.strptime(text.strip(), form).replace(tzinfo=tz)
        except ValueError:
            continue
    raise ValueError(f"{text!r} is no time (try 2026-01-02 15:04:05)")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidegauge", description="Capacity analysis of HTTP access logs on Spark.")
    cmds = top.add_subparsers(dest="command")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("logs", nargs="*", help="log files, directories or patterns, gzip or plain; - is standard input")
    common.add_argument("--dialect", default="auto")
    common.add_argument("--tz", default="UTC", help="zone of dates that carry none")
    common.add_argument("--xff-capture", type=int, default=0)
    common.add_argument("--classes", help="JSON file of class rules")
    common.add_argument("--since", default="")
    common.add_argument("--until", default="")
    common.add_argument("--tails", default="1s,3s,7s")
    common.add_argument("--read-timeout", type=duration_ms, default=7000)
    common.add_argument("--top", type=int, default=10)
    common.add_argument("--max-paths", type=int, default=200_000)
    common.add_argument("--store", default="", help="folder of stored counts: the logs are counted into it as --run, and all its runs are reported on")
    common.add_argument("--run", default="", help="name of the run to store, such as a day; one that is there already isn't read again")
    common.add_argument("--out", "-o", default="")
    for name in ("analyze", "check"):
        a = cmds.add_parser(name, parents=[common])
        a.add_argument("--format", choices=render.FORMATS, default="text")
        a.add_argument("--exit-on", choices=("warn", "bad", "error"), type=str.lower)
    p = cmds.add_parser("profile", parents=[common])
    for flag, kind, default in (("name", str, ""), ("description", str, ""), ("base-url", str, ""), ("target", str, "edge"), ("host-header", str, ""), ("bypass", str, ""), ("pool-size", int, 40), ("min-ok", float, 0.95), ("max-p95", duration_ms, 5000), ("max-failed", float, 0.05), ("safe-peak", int, 0), ("allow-hosts", str, "")):
        p.add_argument(f"--{flag}", type=kind, default=default)
    cmds.add_parser("version")
    cmds.add_parser("help")
    return top


def options_of(a: argparse.Namespace) -> Options:
    classes = None
    if a.classes:
        with open(a.classes, encoding="utf-8") as f:
            classes = load(f.read())
    pooled = a.command == "profile"
    tails = [duration_ms(t) for t in a.tails.split(",") if t.strip()]
    return Options(classes=classes, tails_ms=tails, read_timeout_ms=a.read_timeout, top_paths=a.top, max_paths=a.max_paths, since=instant(a.since, a.tz), until=instant(a.until, a.tz), pool_size=a.pool_size if pooled else 0, pool_min_ok=a.min_ok if pooled else 0.95, zone=a.tz, xff_capture=a.xff_capture).checked()


def log_name(path: str) -> str:
    return "" if path == "-" else os.path.basename(path).removesuffix(".gz").removesuffix(".log")


def write_out(spark, path: str, text: str) -> None:
    """To a file of the driver, or to any store that Spark writes where the path has a scheme."""
    if not re.match("[A-Za-z][A-Za-z0-9+.-]+:/", path):
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def main(argv: list[str] | None = None, spark=None, stdout=None, stderr=None) -> int:
    """Exit code: 0 done, 1 a finding reached --exit-on, 2 the run couldn't be made."""
    stdout, stderr = stdout or sys.stdout, stderr or sys.stderr
    say = lambda s: print(f"tidegauge: {s}", file=stderr)
    top = parser()
    argv = list(sys.argv[1:] if argv is None else argv)
    try:
        if argv and argv[0] in ("analyze", "check", "profile"):
            sub = top._subparsers._group_actions[0].choices[argv[0]]
            a = sub.parse_intermixed_args(argv[1:])
            a.command = argv[0]
        else:
            a = top.parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 2
    if a.command == "version":
        print(TOOL, file=stdout)
        return 0
    if a.command in (None, "help"):
        top.print_help(stdout if a.command else stderr)
        return 0 if a.command else 2
    if not a.logs and not a.store:
        say("name at least one log file, or - for standard input")
        return 2
    if a.store and bool(a.logs) != bool(a.run):
        say("a store takes logs under the name of a --run, and a name only with logs")
        return 2
    try:
        opts = options_of(a)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("tidegauge").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if a.store:
            if a.logs and not store.append(spark, a.logs, a.store, a.run, a.dialect, opts):
                say(f"{a.run} is stored already, its logs aren't read")
            report = store.report(spark, a.store, replace(opts, since=None, until=None))
        else:
            report = analyze(spark, a.logs, a.dialect, opts).report
        if a.dialect == "auto":
            say(f"reading {report['source'] if a.store else a.logs[0]} as {report['dialect']}")
        outside = report["counts"]["parsed"] - report["counts"]["in_window"]
        if outside:
            say(f"{outside} requests fell outside the window")
        if a.command == "profile":
            po = ProfileOptions(a.base_url, a.name or log_name(a.logs[0] if a.logs else a.store), a.description, a.target, a.host_header, a.bypass, a.read_timeout, a.max_p95, a.max_failed, a.safe_peak, [h.strip() for h in a.allow_hosts.split(",") if h.strip()])
            try:
                doc, said = build_profile(report, po)
            except ProfileError as e:
                for w in e.warnings:
                    say(f"warning: {w}")
                raise
            for w in said:
                say(f"warning: {w}")
            result = render.to_json(doc)
        else:
            result = render.render(report, a.format, not a.out and render.colours(stdout))
        if a.out:
            write_out(spark, a.out, result)
        else:
            stdout.write(result)
    except (ValueError, OSError, ZoneInfoNotFoundError, PySparkException, Py4JError) as e:  # a run that can't be made ends with a message
        say(str(e).split("\n")[0])
        return 2
    if getattr(a, "exit_on", None) and at_least(worst(report["findings"]), a.exit_on.upper()):
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
