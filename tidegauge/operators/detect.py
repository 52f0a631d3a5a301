"""Dialect detection: every parser reads a sample of the first file, the one that reads most lines wins."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.dialects import cloudfront, known, parse
from tidegauge.sources import head_lines
from tidegauge.sources.reader import SCHEMA

SAMPLE_LINES, SAMPLE_BYTES = 200, 1 << 20


class DetectionError(ValueError):
    """No dialect, or more than one, reads the sample best."""


def sample(lines: DataFrame) -> DataFrame:
    """The first lines of the first file: at most 200 within 1 MiB, the last of several left out as it may be cut."""
    rows = lines.where("file_idx = 0").orderBy("line_block", "line_no").limit(SAMPLE_LINES + 1).collect()
    sizes = accumulate(len((r["value"] or "").encode()) + 1 for r in rows)
    fit = max(1, sum(size <= SAMPLE_BYTES for size in sizes))
    kept = rows[:SAMPLE_LINES] if fit > SAMPLE_LINES else rows[:fit][: max(1, fit - 1)]
    return lines.sparkSession.createDataFrame([tuple(r) for r in kept], lines.schema).coalesce(1)


def votes(lines: DataFrame, tz: str = "UTC", xff_capture: int = 0, one_block: bool = False) -> DataFrame:
    """dialect, parsed: how many lines each parser reads. ``one_block``: the lines are one block, in order and in one partition."""
    out = None
    for name in known():
        read = cloudfront.with_heads(lines, ordered=True, one_block=True) if one_block and name == "cloudfront" else lines
        one = parse(read, name, tz, xff_capture).agg(F.count_if(F.col("parse_status") == "parsed").alias("parsed")).select(F.lit(name).alias("dialect"), "parsed")
        out = one if out is None else out.unionByName(one)
    return out


def winner(counts: dict[str, int]) -> str:
    best = max(counts.values(), default=0)
    top = [n for n, c in counts.items() if c == best]
    if best == 0:
        raise DetectionError("no dialect reads any line of the sample; name one")
    if len(top) > 1:
        raise DetectionError(f"the sample reads equally well as {' and '.join(top)}; name one")
    return top[0]


def detect(lines: DataFrame, tz: str = "UTC", xff_capture: int = 0) -> str:
    """The dialect that reads most of the first lines."""
    return winner({r["dialect"]: r["parsed"] for r in votes(sample(lines), tz, xff_capture, one_block=True).collect()})


def head_votes(spark: SparkSession, path: str, tz: str = "UTC", xff_capture: int = 0) -> DataFrame:
    """``votes`` on the first lines of a file, at most 200 within 1 MiB, without a scan of it; the last of several is left out, as it may be cut."""
    head = head_lines(spark, path, SAMPLE_BYTES)[: SAMPLE_LINES + 1]
    kept = head[:-1] if len(head) > 1 else head
    lines = spark.createDataFrame([(0, 0, i, x) for i, x in enumerate(kept)], SCHEMA).coalesce(1)
    return votes(lines, tz, xff_capture, one_block=True)


def detect_file(spark: SparkSession, path: str, tz: str = "UTC", xff_capture: int = 0) -> str:
    """The dialect that reads most lines of a file's head."""
    return winner({r["dialect"]: r["parsed"] for r in head_votes(spark, path, tz, xff_capture).collect()})
