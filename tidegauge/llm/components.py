"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import BROADCAST_ROWS, discard, materialize


def _star(edges: DataFrame, large: bool, small_table: bool) -> DataFrame:
    """Link neighbours of each vertex to the smallest of them (large: the larger ones; small: the smaller ones)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    low = F.broadcast(low) if small_table else low
    if large:
        return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    out = both.join(low, "a").select(F.col("b").alias("v"), "m", "a")
    return out.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(v, comp) for every vertex of ``edges`` (a, b): comp is the smallest vertex it reaches.

    Self loops and repeated edges are harmless, rows with a null end are ignored, an empty table gives no rows.
    Each round is written to the shared scratch folder. Only two numbers a round come to the driver; a vertex table
    is broadcast only while there are at most ``broadcast_rows`` edges.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        small_table = 2 * state["n"] <= broadcast_rows
        last, now = now, materialize(_star(_star(now, True, small_table), False, small_table), "cc")
        discard(last)
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("v"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct())
