"""The report of a small log whose figures are known, end to end."""

import gzip
import io
import json

import pytest

from tidegauge.cli import main
from tidegauge.plans import profile as P
from tidegauge.plans import render
from tidegauge.plans.report import Options, analyze

ASSETS = ("/a.js", "/b.css", "/logo.svg")


def line(sec, path, status=200, wait=3, total=None, term="----", ms=0, host="www.example.test", bytes_=100):
    total = wait + 2 if total is None else total
    return f'198.51.100.9:5000 [02/Mar/2026:10:00:{sec:02d}.{ms:03d}] web~ app/s1 0/0/1/{wait}/{total} {status} {bytes_} - - {term} 3/3/0/0/0 0/0 {{{host}}} "GET {path} HTTP/1.1"'


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    rows = [line(0, "/news/one", wait=900), line(0, ASSETS[0]), line(0, "/news/one?_rsc=1", wait=40)]
    rows += [line(2, ASSETS[i % 3], ms=i) for i in range(6)] + [line(2, "/search?q=a", wait=1200), line(3, "/api/x", 500, wait=20, term="sD--"), line(5, "/news/two", 504, wait=7400, total=7400, term="sD--"), "proxy web started", "", line(5, "/", wait=-1, total=50)]
    path = tmp_path_factory.mktemp("logs") / "site.log"
    path.write_text("\n".join(rows) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def report(spark, log):
    return analyze(spark, [log], options=Options(pool_size=40)).report


def test_measurements(report):
    r = report
    assert (r["dialect"], r["window_seconds"], r["silent_seconds"]) == ("haproxy", 6, 2)
    assert r["counts"] == {"lines": 15, "parsed": 13, "skipped": 2, "malformed": 0, "malformed_share": 0.0, "in_window": 13}
    assert (r["rate"]["peak_per_sec"], r["rate"]["p50_per_sec"], r["rate"]["p95_per_sec"]) == (7, 1.0, 7.0)
    assert f"{r['rate']['peak_at']:%H:%M:%S}" == "10:00:02"
    lat = r["latency"]
    assert (lat["measured"], lat["p50_ms"], lat["p95_ms"], lat["max_ms"]) == (13, 3.0, 1200.0, 7400.0)
    assert [(t["over_ms"], t["count"]) for t in lat["tails"]] == [(1000.0, 2), (3000.0, 1), (7000.0, 1)]
    assert [(c["name"], c["count"], c["peak_per_sec"]) for c in r["classes"]] == [("rsc_nav", 1, 1), ("static", 7, 6), ("search", 1, 1), ("api", 1, 1), ("doc", 3, 2)]
    assert [(s["label"], s["count"]) for s in r["statuses"]] == [("2xx", 11), ("5xx", 2)]
    assert r["termination"] == [{"label": "sD--", "count": 2, "share": 2 / 13}]
    assert r["hosts"] == ["www.example.test"] and r["audience"]["countable"] and r["cache"] is None
    assert r["top_paths"][0]["path"] == ASSETS[0] and r["paths_seen"] == 8


def test_rows_without_a_wait_are_not_measured(spark):
    from tidegauge.dialects import parse
    from tidegauge.operators import metrics as M
    from tidegauge.operators.classes import DEFAULT
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([(0, 0, 0, line(1, "/a", wait=-1, total=-1)), (0, 0, 1, line(1, "/b", wait=5))], "file_idx int, line_block long, line_no long, value string")
    p = M.prepared(parse(lines, "haproxy").withColumn("ord", F.col("line_no")), DEFAULT.column())
    got = M.summary(p).where("cls is null").first()
    assert (got.requests, got.measured, got.max_ms) == (2, 1, 5)


def test_findings(report):
    found = {(f["check"], f["target"]): f["status"] for f in report["findings"]}
    assert found[("errors", "5xx")] == "BAD" and found[("wait", "read timeout")] == "BAD"
    assert found[("errors", "server timeout")] == "WARN" and found[("wait", "1s tail")] == "WARN" and found[("coverage", "window")] == "WARN"
    assert found[("wait", "doc")] == "OK" and found[("mix", "static")] == "OK"
    order = [f["status"] for f in report["findings"]]
    assert order == sorted(order, key=["ERROR", "BAD", "WARN", "OK"].index)


def test_profile(report):
    doc, said = P.build(report, P.ProfileOptions("https://edge.example.test", max_p95_ms=9000))
    assert [c["name"] for c in doc["classes"]] == ["rsc_nav", "static", "search", "doc"]
    assert doc["pools"]["doc"] == ["/", "/news/one"] and doc["slo"]["brake_class"] == "doc" and doc["slo"]["max_p95_ms"] == 5250
    assert any("api" in w for w in said) and any("brake" in w for w in said)
    with pytest.raises(P.ProfileError):
        P.build(report, P.ProfileOptions())
    with pytest.raises(P.ProfileError):
        P.build(report | {"pools": {}}, P.ProfileOptions("https://x"))
    assert P.is_opaque("/reset/a1b2c3d4e5f6a7b8c9d0e1") and not P.is_opaque("/news/48211") and not P.is_opaque("/a-long-slug-with-many-words-2026")


def test_renderings(report):
    text, md = render.render(report, "text"), render.render(report, "markdown")
    lines = [" ".join(x.split()) for x in text.splitlines()]
    assert "busiest second 7, 2026-03-02 10:00:02" in lines and any(x.startswith("longer than 7 s ") for x in lines)
    assert [x for x in lines if x[:1] in "🟢🟡🔴⛔" and x[:1]] == [f"{m} {s}: {sum(f['status'] == s for f in report['findings'])}" for m, s in zip("🟢🟡🔴⛔", ("OK", "WARN", "BAD", "ERROR")) if any(f["status"] == s for f in report["findings"])]
    assert sum(x.startswith(tuple(f"{f['check']}/{f['target']}: " for f in report["findings"])) for x in lines) == len(report["findings"])
    assert "| `static` | 7 |" in md and "<- this log" in md
    assert json.loads(render.render(report, "json"))["rate"]["peak_at"] == "2026-03-02T10:00:02Z"
    assert render.cell("a|b") == "a\\|b" and render.cut("abcdefgh", 6) == "abc…"
    with pytest.raises(ValueError):
        render.render(report, "xml")


def test_command_line(spark, log, tmp_path, monkeypatch):
    out, err = io.StringIO(), io.StringIO()
    assert main(["analyze", log, "--exit-on", "bad"], spark, out, err) == 1
    assert "reading" in err.getvalue() and "haproxy" in out.getvalue()
    assert main(["check", "--format", "json", "--since", "2026-03-02 10:00:02", "--until", "2026-03-02T10:00:03Z", log, "-o", str(tmp_path / "r.json")], spark, out, err) == 0
    got = json.loads((tmp_path / "r.json").read_text())
    assert got["counts"]["parsed"] == 13 and got["counts"]["in_window"] == 7
    assert main(["profile", log, log, "--base-url", "https://x", "--allow-hosts", "b.test,a.test", "-o", str(tmp_path / "p.json")], spark, out, err) == 0
    doc = json.loads((tmp_path / "p.json").read_text())
    assert doc["name"] == "site" and doc["safety"]["allow_hosts"] == ["a.test", "b.test"] and doc["_measured"]["requests"] == 26
    assert main(["version"], spark, out, err) == 0 and main(["analyze"], spark, out, err) == 2 and main(["analyze", "/no/such.log"], spark, out, err) == 2
    assert main(["analyze", log, "--exit-on", "never"], spark, out, err) == 2 and main(["analyze", log, "--since", "2026-03-03", "--until", "2026-03-02"], spark, out, err) == 2


def test_gzip_is_told_by_content(spark, log, tmp_path):
    from tidegauge.sources import read_lines, source_label

    raw = open(log, "rb").read()
    odd, plain, right = tmp_path / "odd.log", tmp_path / "plain.gz", tmp_path / "right.log.gz"
    odd.write_bytes(gzip.compress(raw))
    plain.write_bytes(raw)
    right.write_bytes(gzip.compress(raw))
    want = [r.value for r in read_lines(spark, [log]).orderBy("line_block", "line_no").collect()]
    for p in (odd, plain, right):
        assert [r.value for r in read_lines(spark, [str(p)]).orderBy("line_block", "line_no").collect()] == want
    assert read_lines(spark, [log, log]).count() == 2 * len(want)
    assert source_label([log, "b"]) == "site.log and 1 more" and source_label(["-"]) == "(standard input)" and source_label([]) == "(none)"


def test_a_line_at_the_cap_fails_the_run(spark, tmp_path):
    from tidegauge.sources import read_lines

    p = tmp_path / "long.log"
    p.write_text("short\n" + "x" * (1 << 20) + "\n")
    with pytest.raises(Exception, match="cap"):
        read_lines(spark, [str(p)]).select("value").collect()


def test_directories_and_patterns_are_one_scan(spark, log, tmp_path):
    from tidegauge.sources import read_lines, resolve

    raw = open(log, "rb").read()
    names = [f"part {i:02d}.log" for i in range(20)]
    for i, name in enumerate(names):
        (tmp_path / name).write_bytes(b"first of %d\n" % i + raw)
    (tmp_path / "x%20y.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "odd.log").write_bytes(gzip.compress(raw))
    (tmp_path / ".hidden").write_bytes(raw)
    (tmp_path / "below").mkdir()
    assert [p.rsplit("/", 1)[-1] for p in resolve(spark, [str(tmp_path)])] == ["odd.log", *names, "x%20y.gz"]
    some = read_lines(spark, [f"{tmp_path}/part*.log"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == plan.count("BatchScan access_log_lines") == 1 and "Join" not in plan
    other = read_lines(spark, [f"{tmp_path}/part*.log"], schemes=())  # as for a store that Python doesn't open
    plan = other._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "BroadcastHashJoin" in plan
    assert sorted(map(tuple, other.select("file_idx", "value").collect())) == sorted(map(tuple, some.select("file_idx", "value").collect()))
    heads = some.where("value like 'first of %'").orderBy("file_idx").collect()
    assert [(r.file_idx, r.value) for r in heads] == [(i, f"first of {i}") for i in range(20)]
    per_line = raw.count(b"\n")
    twice = read_lines(spark, [str(tmp_path / "odd.log"), str(tmp_path), str(tmp_path / "odd.log")])
    assert {r.file_idx: r["count"] for r in twice.groupBy("file_idx").count().collect()} == {0: per_line, 1: per_line, 22: per_line, 23: per_line, **{i + 2: per_line + 1 for i in range(20)}}
    with pytest.raises(FileNotFoundError):
        read_lines(spark, [f"{tmp_path}/none*.log"])


def test_detection_reads_the_head_of_a_file_alone(spark, log, tmp_path):
    from tidegauge.operators.detect import DetectionError, detect_file
    from tidegauge.sources import head_lines

    raw = open(log, "rb").read()
    want = raw.decode().split("\n")[:-1]
    squeezed, long = tmp_path / "two.gz", tmp_path / "long.log"
    squeezed.write_bytes(gzip.compress(raw) + gzip.compress(raw))
    long.write_bytes(raw + b"nothing of a log\n" * 100_000)
    assert head_lines(spark, log) == want and head_lines(spark, str(squeezed)) == want + want
    assert head_lines(spark, log, len(want[0]) + 5) == want[:1] and head_lines(spark, str(squeezed), 300) == head_lines(spark, log, 300)
    assert detect_file(spark, log) == detect_file(spark, str(squeezed)) == detect_file(spark, str(long)) == "haproxy"
    (tmp_path / "empty.log").write_bytes(b"")
    with pytest.raises(DetectionError):
        detect_file(spark, str(tmp_path / "empty.log"))


def test_a_parser_of_ones_own(spark, tmp_path):
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from tidegauge import dialects
    from tidegauge.dialects import nginx
    from tidegauge.operators.detect import detect_file

    def parse(lines, tz="UTC", xff_capture=0):
        return nginx.parse(lines.withColumn("value", F.translate("value", "'", '"')), tz=tz, xff_capture=xff_capture).where("parse_status = 'parsed'")

    with pytest.raises(ValueError):
        dialects.register("nginx", nginx)
    dialects.register("mine", SimpleNamespace(parse=parse, LATENCY_FIELD="own time"))
    try:
        p = tmp_path / "own.log"
        p.write_text("198.51.100.9 - - [02/Mar/2026:10:00:00 +0000] 'GET /a HTTP/1.1' 200 5 '-' 'agent'\n" * 3)
        assert detect_file(spark, str(p)) == "mine" and dialects.known()[-1] == "mine" and not dialects.is_cdn("mine")
        assert analyze(spark, [str(p)]).report["counts"]["parsed"] == 3
    finally:
        for table in (dialects._MODULES, dialects.LATENCY_FIELD, dialects.CACHE_FIELD):
            table.pop("mine", None)
