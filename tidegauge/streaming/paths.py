"""Busy and distinct paths of a stream, by sketches whose size doesn't follow the paths.

For each class and span of time the state is one frequent-items sketch and one HyperLogLog sketch; the watermark lets go
of a span once it is past. Sketches of spans and classes merge, so a day's or all classes' figures come from the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.classes import DEFAULT, ClassSet

#: Paths a sketch follows. Its map has the next power of two above 4/3 of that, of which the error follows.
TRACKED = 10_000


def error_share(tracked: int = TRACKED) -> float:
    """By which share of a sketch's requests a path's count may be wrong; a path with a larger share is never missed."""
    slots = 1
    while slots * 3 < tracked * 4:
        slots *= 2
    return 3.5 / slots


def path_sketches_stream(events: DataFrame, classes: ClassSet = DEFAULT, span: str = "1 hour", late: str = "1 minute", tracked: int = TRACKED) -> DataFrame:
    """cls, span_start, requests, fivexx, busy (sketch), failing (sketch of paths answered 5xx), paths (sketch) in append mode."""
    known = events.where("path is not null").withColumn("cls", classes.column()).withColumn("bad", F.when(F.col("status") >= 500, F.col("path")))
    sketch = lambda c: F.expr(f"approx_top_k_accumulate({c}, {int(tracked)}) FILTER (WHERE {c} IS NOT NULL)")
    found = known.withWatermark("ts", late).groupBy(F.window("ts", span), "cls").agg(F.count(F.lit(1)).alias("requests"), F.count("bad").alias("fivexx"), sketch("path").alias("busy"), sketch("bad").alias("failing"), F.hll_sketch_agg("path").alias("paths"))
    return found.select("cls", F.col("window.start").alias("span_start"), "requests", "fivexx", "busy", "failing", "paths")


def _listed(merged: DataFrame, sketch: str, of: str, k: int, tracked: int) -> DataFrame:
    rows = merged.select("cls", of, F.posexplode(F.expr(f"approx_top_k_estimate({sketch}, {int(k)})")).alias("place", "e"))
    return rows.where("e.item is not null").select("cls", (F.col("place") + 1).alias("place"), F.col("e.item").alias("path"), F.col("e.count").alias("n"), F.ceil(F.col(of) * F.lit(error_share(tracked))).cast("long").alias("error"))


def _merged(spans: DataFrame, tracked: int, total: bool) -> DataFrame:
    join = lambda c: F.expr(f"approx_top_k_combine({c}, {int(tracked)})").alias(c)
    cls: Column = F.lit(None).cast("string") if total else F.col("cls")
    return spans.groupBy(cls.alias("cls")).agg(F.sum("requests").alias("requests"), F.sum("fivexx").alias("fivexx"), join("busy"), join("failing"), F.hll_union_agg("paths").alias("paths"))


def both(spans: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Stored spans merged by class, and for all classes together (cls null)."""
    return _merged(spans, tracked, False).unionByName(_merged(spans, tracked, True))


def top_paths(merged: DataFrame, k: int = 10, tracked: int = TRACKED) -> DataFrame:
    """cls, place, path, n, error: the busiest paths, each count right within ``error``."""
    return _listed(merged, "busy", "requests", k, tracked)


def top_5xx(merged: DataFrame, k: int = 10, tracked: int = TRACKED) -> DataFrame:
    return _listed(merged, "failing", "fivexx", k, tracked)


def distinct_paths(merged: DataFrame) -> DataFrame:
    """cls, requests, distinct_paths (within some 2 in 100, two times in three)."""
    return merged.select("cls", "requests", F.hll_sketch_estimate("paths").alias("distinct_paths"))
