"""A log of forty requests with figures worked out by hand, and the one pass that its report is made of."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_golden import line
from tidegauge.dialects import parse
from tidegauge.operators import metrics as M
from tidegauge.operators.classes import DEFAULT
from tidegauge.plans import profile as P
from tidegauge.plans.findings import summarize
from tidegauge.plans.report import Options, analyze, cells_of, place
from tidegauge.sources import read_lines

FILES = ("/a.css", "/b.js", "/c.svg", "/d.png", "/e.woff2")


def _requests():
    """second, path, status, wait, termination: static 21, rsc_nav 7, doc 9, search 2, api 1."""
    static = [(s, FILES[i % 5], 200, 2 if i < 5 else 3, "----") for i, s in enumerate([5] * 9 + [0] * 1 + [1] * 2 + [2] * 3 + [3] * 3 + [4] * 3)]
    nav = [(s, f"/n{i % 3}?_rsc=x", 200, w, "----") for i, (s, w) in enumerate(zip((5, 5, 5, 5, 1, 2, 3), (21, 30, 48, 33, 25, 27, 29)))]
    doc = [(s, p, c, w, t) for s, p, c, w, t in [(5, "/", 200, 120, "----"), (5, "/", 200, 1060, "----"), (5, "/one", 200, 1889, "----"), (5, "/two", 504, 7301, "sD--"), (0, "/", 200, 110, "----"), (2, "/one", 200, 2040, "----"), (3, "/", 200, 130, "----"), (4, "/one", 200, 140, "----"), (4, "/", 200, 150, "----")]]
    rest = [(5, "/search?q=a", 200, 1204, "----"), (3, "/search?q=b", 200, 640, "----"), (4, "/api/cart", 500, 513, "----")]
    return sorted(static + nav + doc + rest, key=lambda r: r[0])


@pytest.fixture(scope="module")
def example(tmp_path_factory):
    path = tmp_path_factory.mktemp("worked") / "edge.log"
    path.write_text("".join(line(s, p, c, wait=w, term=t) + "\n" for s, p, c, w, t in _requests()))
    return str(path)


def test_the_figures(spark, example):
    per_second = Counter(r[0] for r in _requests())
    assert sorted(per_second.values()) == [2, 3, 5, 6, 6, 18]
    r = analyze(spark, [example], options=Options(pool_size=40)).report
    assert (r["dialect"], r["counts"]["parsed"], r["window_seconds"], r["silent_seconds"]) == ("haproxy", 40, 6, 0)
    assert (r["rate"]["peak_per_sec"], r["rate"]["p99_per_sec"], r["rate"]["p95_per_sec"], r["rate"]["p50_per_sec"]) == (18, 18.0, 18.0, 5.0)
    assert round(r["rate"]["mean_per_sec"], 1) == 6.7
    assert [r["latency"][k] for k in ("p50_ms", "p95_ms", "p99_ms", "max_ms")] == [3.0, 1889.0, 7301.0, 7301.0]
    assert [(t["over_ms"], t["count"]) for t in r["latency"]["tails"]] == [(1000.0, 5), (3000.0, 1), (7000.0, 1)]
    assert [(c["name"], c["count"], c["peak_per_sec"], c["latency"]["p95_ms"], c["distinct_paths"]) for c in r["classes"]] == [("rsc_nav", 7, 4, 48.0, 3), ("static", 21, 9, 3.0, 5), ("search", 2, 1, 1204.0, 1), ("api", 1, 1, 513.0, 1), ("doc", 9, 4, 7301.0, 3)]
    assert summarize(r["findings"]) == {"OK": 6, "WARN": 2, "BAD": 2, "ERROR": 0}
    doc, said = P.build(r, P.ProfileOptions("https://edge.example.test"))
    assert [c["name"] for c in doc["classes"]] == ["rsc_nav", "static", "search", "doc"] and list(doc["pools"]) == ["rsc_nav", "static", "search", "doc"]
    assert doc["safety"]["safe_peak_rps"] == 18 and any("api" in w for w in said)


def test_tables_of_the_one_pass_are_those_of_the_events(spark, example):
    parsed = parse(read_lines(spark, [example]), "haproxy").withColumn("ord", place())
    t, p = M.Tables(cells_of(parsed, Options().checked()).persist()), M.prepared(parsed.where("parse_status = 'parsed'"), DEFAULT.column())
    rows = lambda df: Counter(df.select(*sorted(df.columns)).collect())
    assert rows(t.summary()) == rows(M.summary(p))
    assert rows(t.per_second()) == rows(M.per_second(p))
    assert rows(t.wait_histogram()) == rows(M.wait_histogram(p))
    assert rows(t.path_stats()) == rows(M.path_stats(p))
    for c in M.LABELS:
        assert rows(t.label_counts(c)) == rows(M.label_counts(p, c))
    t.cells.unpersist()


def test_the_pass_scans_and_shuffles_once(spark, example):
    parsed = parse(read_lines(spark, [example]), "haproxy").withColumn("ord", place())
    plan = cells_of(parsed, Options().checked())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "InMemoryTableScan" not in plan


def test_lines_outside_the_window_are_counted_as_lines_alone(spark):
    rows = [(0, 0, 0, line(0, "/a")), (0, 0, 1, line(4, "/b")), (0, 0, 2, "proxy web started"), (0, 0, 3, None), (0, 0, 4, line(4, "/b").replace(" 200 ", " x "))]
    parsed = parse(spark.createDataFrame(rows, "file_idx int, line_block long, line_no long, value string"), "haproxy").withColumn("ord", place())
    o = Options(until=parsed.where("line_no = 1").first()["ts"]).checked()
    t = M.Tables(cells_of(parsed, o))
    assert {r["parse_status"]: r["count"] for r in t.lines().collect()} == {"parsed": 2, "skipped": 2, "malformed": 1}
    assert [(r["cls"], r["path"]) for r in t.path_stats().orderBy(F.col("cls").isNull()).collect()] == [("doc", "/a"), (None, "/a")]
    none = M.Tables(cells_of(parsed.limit(0), o))
    assert none.summary().count() == 0 and none.per_second().count() == 0 and none.lines().count() == 0


def test_a_row_tells_which_timer_its_wait_is_of(spark):
    rows = [(0, 0, i, v) for i, v in enumerate([line(0, "/", wait=5), line(0, "/", wait=-1, total=9), line(0, "/", wait=-1, total=-1)])]
    got = parse(spark.createDataFrame(rows, "file_idx int, line_block long, line_no long, value string"), "haproxy").orderBy("line_no").collect()
    assert [r["latency_source"] for r in got] == ["response", "total", None]
