"""CloudFront headers carried over lines and blocks, against a plain walk."""

import gzip
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.dialects import cloudfront, parse
from tidegauge.sources import one_range, read_lines

COLUMNS = ["date", "time", "cs-uri-stem", "sc-status", "cs-method"]


def log(seed, n=400):
    """Lines, and for each request its path if a header names it, None if the line can't be read."""
    rnd, names, rows, want = random.Random(seed), None, [], []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.08:
            names = rnd.sample(COLUMNS, k=rnd.choice([5, 5, 5, 3]))
            rows.append(rnd.choice(["#Fields: ", "  #fields:\t", "#FIELDS:"]) + " ".join(names))
        elif kind < 0.12:
            rows.append(rnd.choice(["#Fields:", "#Fields:  \t", "#Version: 1.0", ""]))  # name nothing
        else:
            said = {"date": "2026-03-02", "time": "10:00:00", "cs-uri-stem": f"/p{i}", "sc-status": "200", "cs-method": "GET"}
            rows.append("\t".join(said[c] for c in names or COLUMNS))
            want.append(f"/p{i}" if names and {"date", "time", "cs-uri-stem", "sc-status"} <= set(names) else None)
    return rows, want


@pytest.mark.parametrize("split", [0, 300, 5000])
def test_headers_over_blocks_of_files(spark, tmp_path, split):
    files, want = [], []
    for i, packed in enumerate([False, True, False]):
        rows, paths = log(i)
        text = "".join(r + "\n" for r in rows).encode()
        path = tmp_path / f"f{i}.log"
        path.write_bytes(b"".join(gzip.compress(text[j : j + 900]) for j in range(0, len(text), 900)) if packed else text)
        files.append(str(path))
        want += [(i, p) for p in paths]
    lines = read_lines(spark, files, split=split)
    assert split or one_range(spark, files)
    for read in (cloudfront.with_heads(lines, ordered=True, one_block=not split), lines.repartition(7)):
        got = parse(read, "cloudfront").where("parse_status <> 'skipped'").orderBy("file_idx", "line_block", "line_no").collect()
        assert [(r.file_idx, r.path) for r in got] == want


def test_many_carried_blocks_are_shuffled(spark, monkeypatch, tmp_path):
    rows, paths = log(9)
    path = tmp_path / "f.log"
    path.write_text("".join(r + "\n" for r in rows))
    monkeypatch.setattr(cloudfront, "FEW_BLOCKS", 3)
    read = cloudfront.with_heads(read_lines(spark, [str(path)], split=300), ordered=True)
    got = parse(read, "cloudfront").where("parse_status <> 'skipped'").orderBy("line_block", "line_no").collect()
    assert [r.path for r in got] == paths


def test_a_hundred_thousand_headers_in_one_read(spark, tmp_path):
    """Twice the headers take about twice the time, and files of one range are read once, without a shuffle."""
    took = {}
    for n in (1_000, 50_000, 100_000):
        path = tmp_path / f"{n}.log"
        path.write_text("".join(f"#Fields: date time cs-uri-stem sc-status c{i}\n2026-03-02\t10:00:00\t/p{i}\t200\n" for i in range(n)))
        lines = read_lines(spark, [str(path)])
        read = cloudfront.with_heads(lines, ordered=True, one_block=one_range(spark, [str(path)]))
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan") == 1 and "Exchange" not in plan and "Join" not in plan
        began = time.perf_counter()
        row = read.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(cloudfront.AT)).alias("s"), F.count_if(F.col(cloudfront.AT).isNull()).alias("bare")).first()
        took[n] = time.perf_counter() - began
        assert row["n"] == 2 * n and row["bare"] == 1
    assert took[100_000] < 3 * took[50_000] + 1


def test_a_long_block_in_no_order_is_dealt_over_tasks(spark, monkeypatch):
    """Lines without order whose block is the whole file: no task gets it whole, and headers still reach all lines behind."""
    monkeypatch.setattr(cloudfront, "CUT_BITS", 5)
    heads = {-1: "#Fields: date time", 700: "#Fields: sc-status", 701: "#fields:", 1500: "#Fields: time"}
    rows = [(f, 0, i, heads.get(i, "a\tb") if f == 0 else "a\tb") for f in (0, 1) for i in range(-1, 2000)]
    lines = spark.createDataFrame(rows, "file_idx int, line_block long, line_no long, value string").repartition(7, F.hash("line_no"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cloudfront.with_heads(lines).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(Counter(r.task for r in got if r.file_idx == 0).values()) < 1500
    want = {(f, i): None if f or i < 0 else cloudfront.places(heads[max(h for h in (-1, 700, 1500) if h < i)]) for f, _, i, _ in rows}
    assert len(got) == len(want) and {(r.file_idx, r.line_no): r[cloudfront.AT] for r in got} == want
    assert got[0].asDict().keys() == {"file_idx", "line_block", "line_no", "value", cloudfront.AT, "task"}
