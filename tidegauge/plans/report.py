"""A report: the measurements of one run, as a nested dict of bounded size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.dialects import CACHE_FIELD, LATENCY_FIELD, cloudfront, parse
from tidegauge.operators import metrics as M
from tidegauge.operators.classes import DEFAULT, ClassSet
from tidegauge.operators.detect import detect_file
from tidegauge.sources import one_range, read_files, resolve, source_label

TOOL = "tidegauge 0.1"
Q = (0.5, 0.95, 0.99)


@dataclass(frozen=True)
class Options:
    classes: ClassSet | None = None
    tails_ms: Sequence[int] = (1000, 3000, 7000)
    read_timeout_ms: int = 7000
    top_paths: int = 10
    max_paths: int = 200_000
    since: datetime | None = None
    until: datetime | None = None
    pool_size: int = 0
    pool_min_ok: float = 0.95
    zone: str = "UTC"
    xff_capture: int = 0

    def checked(self) -> Options:
        if self.top_paths <= 0 or self.max_paths <= 0 or self.read_timeout_ms <= 0 or not 0 <= self.pool_min_ok <= 1 or self.pool_size < 0:
            raise ValueError("top, max-paths and read-timeout are positive, min-ok lies in 0..1, pool-size isn't negative")
        if self.since and self.until and self.until <= self.since:
            raise ValueError("until must come after since")
        tails = list(dict.fromkeys([*map(int, self.tails_ms), int(self.read_timeout_ms)]))
        return replace(self, tails_ms=tuple(tails), classes=self.classes or DEFAULT)


@dataclass
class Counts:
    lines: int = 0
    parsed: int = 0
    skipped: int = 0
    malformed: int = 0

    @property
    def malformed_share(self) -> float:
        n = self.parsed + self.malformed
        return self.malformed / n if n else 0.0


@dataclass
class Run:
    """What an analysis is made of: its events, their tables and the report."""

    dialect: str
    events: DataFrame
    report: dict
    options: Options = field(default_factory=Options)


def scan_counts(by_status: DataFrame) -> Counts:
    """From parse_status, count."""
    got = {r["parse_status"]: r["count"] for r in by_status.collect()}
    return Counts(sum(got.values()), got.get("parsed", 0), got.get("skipped", 0), got.get("malformed", 0))


def in_window(o: Options):
    keep = F.lit(True)
    if o.since:
        keep = keep & (F.col("ts") >= F.lit(o.since))
    if o.until:
        keep = keep & (F.col("ts") < F.lit(o.until))
    return keep


def place() -> Column:
    """A line's place over all files as one number, which hash aggregates can compare in place (a struct they'd sort).

    It has 108 bits: 31 for the file, 44 for the block's offset, 33 for the line; ``store`` puts a run's number before them.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    row = F.col("line_no").bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(10,0)")  # within a task; blocks are told apart before it
    return (wide("file_idx") * F.lit(Decimal(1 << 77)) + wide("line_block") * F.lit(Decimal(1 << 33)) + row).cast("decimal(38,0)")


def _share(n: int, total: int) -> float:
    return n / total if total else 0.0


def _utc(t: datetime | None) -> datetime | None:
    return None if t is None else (t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC))


def cells_of(lines: DataFrame, options: Options) -> DataFrame:
    """The cells (``metrics.cells``) of events or of parsed lines, both with ``ord``."""
    keep = in_window(options)
    if "parse_status" in lines.columns:
        keep = (F.col("parse_status") == "parsed") & keep
    return M.cells(M.prepared(lines, options.classes.column()), keep)


def build(lines: DataFrame, dialect: str, source: str, counts: Counts | None, options: Options) -> dict:
    """The report of events, or of parsed lines where ``counts`` is None; both have ``ord``.

    Lines are read once and only counts of them are kept. Only tables of a size set by the options come to the driver.
    """
    o = options.checked()
    return of_cells(cells_of(lines, o), dialect, source, counts, o)


def of_cells(cells: DataFrame, dialect: str, source: str, counts: Counts | None, options: Options) -> dict:
    """The report of cells, however they came together."""
    o = options.checked()
    cs, names = o.classes, o.classes.names()
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    t = M.Tables(cells)
    paths = t.path_stats().persist(StorageLevel.MEMORY_AND_DISK)  # a row a path and class, read several times
    try:
        counts = scan_counts(t.lines()) if counts is None else counts
        rows = {r["cls"]: r for r in t.summary().withColumn("window", M.window_seconds(F.col("first_ts"), F.col("last_ts"))).withColumn("f", F.unix_micros("first_ts")).withColumn("l", F.unix_micros("last_ts")).collect()}
        total = rows.get(None)
        n = total["requests"] if total else 0
        window = total["window"] if total else 0
        seconds = t.per_second()
        peaks = {r["cls"]: r for r in M.peaks(seconds).collect()}
        rates = {(r["cls"], r["q"]): float(r["value"]) for r in M.rate_percentiles(seconds.where("cls is null"), window, Q).collect()} if n else {}
        hist = t.wait_histogram()
        waits = {(r["cls"], r["q"]): float(r["value"]) for r in M.wait_percentiles(hist, Q).collect()}
        tails: dict = {}
        for r in M.tails(hist, o.tails_ms).orderBy("place").collect():
            tails.setdefault(r["cls"], []).append({"over_ms": float(r["over_ms"]), "count": r["n"], "share": r["share"]})
        statuses: dict = {}
        for r in t.label_counts("status_class").collect():
            statuses.setdefault(r["cls"], {})[r["label"]] = r["n"]
        verdicts: dict = {}
        for r in M.top_labels(t.label_counts("cache"), 8).orderBy("place").collect():
            verdicts.setdefault(r["cls"], []).append((r["label"], r["n"]))
        terms = M.top_labels(t.label_counts("term_state").where("cls is null"), 5).orderBy("place").collect()
        hosts = M.top_labels(t.label_counts("host").where("cls is null"), 20).orderBy("place").collect()
        kept = M.cap_paths(paths, o.max_paths, [None, *names])
        known = {r["cls"]: (r["count"], r["n"]) for r in kept.groupBy("cls").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n")).collect()}
        distinct = paths.where("cls is null").count() if known.get(None, (0, 0))[0] == o.max_paths else known.get(None, (0, 0))[0]

        def stat(r, of: int) -> dict:
            out = {"path": r["path"], "count": r["n"], "share": _share(r["n"], of), "ok_share": _share(r["ok"], r["n"])}
            return out | ({"fivexx": r["fivexx"]} if r["fivexx"] else {})

        tops: dict = {}
        for r in M.top_paths(kept, o.top_paths).orderBy("place").collect():
            tops.setdefault(r["cls"], []).append(stat(r, rows[r["cls"]]["requests"]))
        bad = [stat(r, n) for r in M.top_5xx(kept.where("cls is null"), o.top_paths).orderBy("place").collect()]
        pools: dict = {}
        if o.pool_size:
            for r in M.pools(kept, o.pool_size, o.pool_min_ok).orderBy("cls", "place").collect():
                pools.setdefault(r["cls"], []).append(stat(r, rows[r["cls"]]["requests"]))
    finally:
        paths.unpersist()
        cells.unpersist()

    def latency(cls) -> dict | None:
        r = rows.get(cls)
        if r is None or not r["measured"]:
            return None
        return {"field": LATENCY_FIELD[dialect], "measured": r["measured"], "p50_ms": waits[cls, 0.5], "p95_ms": waits[cls, 0.95], "p99_ms": waits[cls, 0.99], "max_ms": float(r["max_ms"]), "tails": tails.get(cls, []), "sum_ns": r["lat_sum_ns"]}

    def cache(cls) -> dict | None:
        r = rows.get(cls)
        if r is None or not r["judged"]:
            return None
        return {"field": CACHE_FIELD[dialect], "measured": r["judged"], "hits": r["hits"], "hit_ratio": r["hits"] / r["judged"], "verdicts": [{"label": v, "count": c, "share": c / r["judged"]} for v, c in verdicts.get(cls, [])]}

    def answers(cls, of: int) -> list[dict]:
        return [{"label": k, "count": statuses[cls][k], "share": _share(statuses[cls][k], of)} for k in M.STATUS_ORDER if statuses.get(cls, {}).get(k)]

    at = lambda us: None if us is None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)
    first, last = (at(total["f"]), at(total["l"])) if total else (None, None)
    peak = peaks.get(None)
    identified = total["identified"] if total else 0
    report = {
        "tool": TOOL, "source": source, "dialect": dialect, "latency_field": LATENCY_FIELD[dialect], "zone": o.zone,
        "counts": {"lines": counts.lines, "parsed": counts.parsed, "skipped": counts.skipped, "malformed": counts.malformed, "malformed_share": counts.malformed_share, "in_window": n},
        "window": {"start": first, "end": last}, "window_seconds": window, "silent_seconds": max(0, window - (peak["busy_seconds"] if peak else 0)),
        "rate": {"peak_per_sec": peak["peak"] if peak else 0, "peak_at": at(peak["peak_sec"] * 1_000_000) if peak else None, "mean_per_sec": _share(n, window), **{k: rates.get((None, q), 0.0) for k, q in zip(("p50_per_sec", "p95_per_sec", "p99_per_sec"), Q)}},
        "statuses": answers(None, n),
        "classes": [
            {"name": c, "label": cs.label(c), "kind": cs.kind(c), "count": rows[c]["requests"], "share": _share(rows[c]["requests"], n), "bytes": rows[c]["bytes"] or 0, "peak_per_sec": peaks[c]["peak"], "distinct_paths": known.get(c, (0, 0))[0],
             "statuses": answers(c, rows[c]["requests"]), "latency": latency(c), "cache": cache(c), "top_paths": tops.get(c, [])}
            for c in names if c in rows
        ],
        "latency": latency(None), "cache": cache(None),
        "termination": [{"label": r["label"], "count": r["n"], "share": _share(r["n"], n)} for r in terms],
        "top_paths": tops.get(None, []), "top_5xx": bad, "hosts": [r["label"] for r in hosts],
        "audience": {"with_identity": identified, "identity_share": _share(identified, n), "countable": n > 0 and _share(identified, n) >= 0.99},
        "paths_seen": known.get(None, (0, 0))[0], "paths_dropped": n - known.get(None, (0, 0))[1], "distinct_paths_dropped": distinct - known.get(None, (0, 0))[0],
        "pools": pools,
    }
    from tidegauge.plans.findings import evaluate

    report["findings"] = evaluate(report, o.read_timeout_ms)
    return report


def parsed_lines(spark: SparkSession, paths: list[str], dialect: str, o: Options) -> tuple[str, DataFrame]:
    """The dialect of logs, told from the first if it is to be, and their parsed lines with ``ord``."""
    files = resolve(spark, paths)
    lines = read_files(spark, files)
    name = detect_file(spark, files[0], o.zone, o.xff_capture) if dialect == "auto" else dialect.lower()
    if name == "cloudfront":
        lines = cloudfront.with_heads(lines, ordered=True, one_block=one_range(spark, files))
    return name, parse(lines, name, o.zone, o.xff_capture).withColumn("ord", place())


def analyze(spark: SparkSession, paths: list[str], dialect: str = "auto", options: Options | None = None) -> Run:
    """Read logs and report on them as one window."""
    o = (options or Options()).checked()
    name, parsed = parsed_lines(spark, paths, dialect, o)
    return Run(name, parsed.where("parse_status = 'parsed'"), build(parsed, name, source_label(paths), None, o), o)
