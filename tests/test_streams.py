"""Streams against the same lines read as a batch."""

import random
import time
import tracemalloc
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_cloudfront import log
from tidegauge.dialects import parse
from tidegauge.dialects.cloudfront import AT, places
from tidegauge.operators.classes import DEFAULT
from tidegauge.sources import read_lines
from tidegauge.streaming import ScanCounter, parsed_stream, path_sketches_stream, read_stream
from tidegauge.streaming import paths as P
from tidegauge.streaming.heads import HeaderCarry


def run(frame, out, mark):
    q = frame.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(mark)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def test_cloudfront_streams_like_a_batch(spark, tmp_path):
    """Files that grow between restarts, cut anywhere: headers are kept by the checkpoint, halves of lines wait."""
    folder, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    folder.mkdir()
    texts = {f"f{i}.log": "".join(r + "\n" for r in log(20 + i, 90)[0]).encode() for i in range(3)}
    rnd = random.Random(1)
    cuts = {n: sorted(rnd.sample(range(len(t)), 2)) + [len(t)] for n, t in texts.items()}
    before = dict.fromkeys(texts, 0)
    for step in range(3):
        for name, text in texts.items():
            if name != "f2.log" or step:  # one file comes later
                with open(folder / name, "ab") as f:
                    f.write(text[before[name] : cuts[name][step]])
                before[name] = cuts[name][step]
        run(parsed_stream(spark, str(folder), "cloudfront").select("file", "line_block", "line_no", "parse_status", "path"), out, mark)
    got = spark.read.parquet(str(out)).orderBy("file", "line_block", "line_no").collect()
    names = sorted(texts)
    batch = parse(read_lines(spark, [str(folder / n) for n in names]), "cloudfront").orderBy("file_idx", "line_block", "line_no").collect()
    assert [(r.file.rsplit("/", 1)[1], r.parse_status, r.path) for r in got] == [(names[r.file_idx], r.parse_status, r.path) for r in batch]
    assert len({r.line_block for r in got if r.file.endswith("f0.log")}) == 3


def nginx(second, path, status=200):
    return f'198.51.100.7 - - [02/Mar/2026:{10 + second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d} +0000] "GET {path} HTTP/1.1" {status} 5 "-" "agent"'


def test_busy_paths_within_the_stated_error(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rnd = random.Random(7)
    seen = [(i, f"/p{int(rnd.random() ** 4 * 4000)}" + rnd.choice(["", ".js"]), rnd.choice([200] * 9 + [503])) for i in range(6000)]
    (folder / "a.log").write_text("".join(nginx(*s) + "\n" for s in seen))
    tracked = 300
    for i in range(2):  # a span is given by the trigger after the one that passes it
        (folder / f"end{i}.log").write_text(nginx(12 * 3600, "/end") + "\n")
        events = read_stream(spark, str(folder), "nginx", tail=True)
        run(path_sketches_stream(events, span="30 minutes", tracked=tracked), tmp_path / "out", tmp_path / "mark")
    spans = spark.read.parquet(str(tmp_path / "out"))
    assert spans.select("span_start").distinct().count() == 4
    merged = P.both(spans, tracked).persist()
    for name in (None, "doc", "static"):
        mine = [s for s in seen if name is None or (name == "static") == s[1].endswith(".js")]
        for found, true in ((P.top_paths, Counter(p for _, p, _ in mine)), (P.top_5xx, Counter(p for _, p, s in mine if s >= 500))):
            rows = [r for r in found(merged, 10, tracked).collect() if r.cls == name]
            bound = -(-sum(true.values()) * P.error_share(tracked) // 1)
            assert [r.place for r in sorted(rows, key=lambda r: r.place)] == list(range(1, 11)) and {r.error for r in rows} == {bound}
            assert all(abs(r.n - true[r.path]) <= bound for r in rows)
            tenth = sorted(true.values())[-10]
            assert all(true[r.path] >= tenth - 2 * bound for r in rows)
            assert {p for p, n in true.items() if n > tenth + 2 * bound} <= {r.path for r in rows}
        (row,) = [r for r in P.distinct_paths(merged).collect() if r.cls == name]
        distinct = len({p for _, p, _ in mine})
        assert row.requests == len(mine) and abs(row.distinct_paths - distinct) < 0.05 * distinct


def test_lines_and_late_requests_are_counted_on_the_way(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    counter = ScanCounter()
    spark.streams.addListener(counter)
    try:
        parts = [[nginx(i, "/a") for i in range(50)] + ["# note", "what is this"], [nginx(3600, "/b"), nginx(3601, "/b", "2x0")], [nginx(3700, "/c")], [nginx(5, "/late"), nginx(66, "/late"), nginx(3800, "/c")]]
        for i, rows in enumerate(parts):
            (folder / f"{i}.log").write_text("".join(r + "\n" for r in rows))
            q = run(path_sketches_stream(read_stream(spark, str(folder), "nginx", tail=True), span="1 minute"), tmp_path / "out", tmp_path / "mark")
        batch = parse(read_lines(spark, [str(folder)]), "nginx").groupBy("parse_status").count().collect()
        want = {r["parse_status"]: r["count"] for r in batch}
        for _ in range(100):
            counts, late = counter.counts(str(q.id))
            if counts.lines == sum(map(len, parts)):
                break
            time.sleep(0.2)
        assert {"parsed": counts.parsed, "skipped": counts.skipped, "malformed": counts.malformed} == want | {k: 0 for k in ("parsed", "skipped", "malformed") if k not in want}
        assert late == 2 and counter.counts()[0].lines >= counts.lines
    finally:
        spark.streams.removeListener(counter)


@pytest.mark.parametrize("tracked", [10, 300, 10_000, 12_288])
def test_error_follows_the_sketch(tracked):
    assert 3.5 / (4 * tracked) < P.error_share(tracked) <= 3.5 / (tracked * 4 / 3) and DEFAULT.names()[-1] == "doc" and F is not None


class _Head:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_long_trigger_of_one_file_is_not_held():
    """120 MB of lines of one file in one trigger, backwards: their headers reach them, and the task holds a small part."""
    heads = {0: "#Fields: date time", 150_000: "#Fields: time date"}

    def batches():
        for n in range(239_000, -1, -1000):
            yield pd.DataFrame({"file": "f", "line_block": 0, "line_no": range(n, n + 1000), "value": [heads.get(i, f"{i:0500d}") for i in range(n, n + 1000)]})

    carry = HeaderCarry(None)
    carry.head, seen = _Head(), Counter()
    tracemalloc.start()
    for lines in carry.handleInputRows(("f",), batches(), None):
        for no, at in zip(lines["line_no"], lines[AT]):
            seen[None if at is None else tuple(at), int(no) > 150_000] += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first, second = (tuple(places(h)) for h in heads.values())
    assert seen == {(None, False): 1, (first, False): 150_000, (second, True): 89_999}
    assert carry.head.value == (list(second),) and peak < 60_000_000
    assert list(carry.handleInputRows(("f",), iter([]), None)) == []
