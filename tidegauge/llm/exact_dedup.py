"""Exact dedup by salted combining of digest groups. DataFrame functions only.

Each row's text gets a digest, and rows with their digests are written without texts. Counting them tells the heavy
digests, those of more than one in ``HEAVY`` rows; there are fewer than ``HEAVY`` of them. Then texts are combined by
(digest, content), in three steps: each task first joins its own equal rows (the map side of an aggregate), so a copy
held a million times leaves a task once; groups meet by digest, those of a heavy digest split by salts of the sending
task; the winners of a heavy digest's salts meet globally. Content is part of the key in every step, so equal digests of
different texts never fall together. After it one row a (digest, content) is left. A digest of one content stands for its
text from then on; rows whose digest has several contents (none is known for SHA-256) are grouped by the text itself.
Rows take their group's winner by digest, heavy groups by a broadcast.

Null text counts as empty. The largest id of a group stays; null ids come before all others, and where all ids are null
keep_id is null. Of rows that repeat both id and text one stays. Other columns are ignored (``deduplicate`` gives them
back). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import discard, join_spread, materialize

HEAVY, SALTS = 2000, 32


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass(frozen=True)
class Groups:
    """What ``combine`` finds: base (doc, doc_id, text, sha, digest) unwritten, rows (doc_id, sha, digest, row) written, their number, groups of two or more (digest, keep_id, group_size, top_row), digests of several contents."""

    base: DataFrame
    rows: DataFrame
    total: int
    groups: DataFrame
    mixed: DataFrame


def _measures() -> list[Column]:
    """A group's largest id, its size, and the one row that stands for it."""
    return [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("top_row")]


def combine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, digest: Callable[[Column], Column] | None = None, heavy: int = HEAVY, salts: int = SALTS) -> Groups:
    """Groups of equal texts; ``normalise`` is applied to texts first, ``digest`` to their SHA-256 (to group by less of it)."""
    said = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("doc_id"), (normalise(said) if normalise else said).alias("text")).withColumn("sha", sha256(F.col("text")))
    base = base.withColumn("digest", digest(F.col("sha")) if digest else F.col("sha"))
    rows = materialize(base.select("doc_id", "sha", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    total = rows.count()
    seen = materialize(rows.groupBy("digest").agg(*_measures()).where("group_size > 1"), "repeated")
    hot = seen.where(F.col("group_size") > max(1, total // heavy)).select("digest", F.lit(True).alias("hot"))
    dealt = base.drop("doc").join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0)))
    merged = dealt.groupBy("digest", "hot", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Only winners that have others to meet go on with their text.
    winners = materialize(merged.select("digest", "hot", F.when(F.col("hot"), F.col("text")).alias("text"), "keep_id", "group_size"), "winners")
    met = winners.where("hot").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).drop("text")
    each = winners.where("hot is null").select("digest", "keep_id", "group_size").unionByName(met)
    told = each.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).where("group_size > 1")
    told = materialize(told.join(seen.select("digest", "top_row"), "digest"), "groups")
    discard(winners, seen)
    return Groups(base, rows, total, told.where("contents = 1").drop("contents"), told.where("contents > 1").select("digest"))


def _by_content(base: DataFrame, mixed: DataFrame) -> DataFrame:
    """The report's rows of mixed digests, grouped by the texts themselves."""
    rows = materialize(base.drop("doc").join(mixed, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "mixed")
    groups = materialize(rows.groupBy("text").agg(*_measures()), "contents")
    return rows.join(groups, "text").withColumn("kept", F.col("row") == F.col("top_row"))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    g = combine(docs, id_col, text_col, **kw)
    clear = g.mixed.isEmpty()
    rows = g.rows if clear else g.rows.join(g.mixed, "digest", "left_anti").select(*g.rows.columns)
    found = join_spread(rows, g.groups, "digest", "group_size", g.total, F.col("row"))
    alone = F.col("group_size").isNull()
    found = found.withColumn("kept", alone | (F.col("row") == F.col("top_row"))).withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    columns = ("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
    return found.select(*columns) if clear else found.select(*columns).unionByName(_by_content(g.base, g.mixed).select(*columns))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    g = combine(docs, id_col, text_col, **kw)
    found = join_spread(g.base.join(g.mixed, "digest", "left_anti"), g.groups.drop("top_row"), "digest", "group_size", g.total, F.col("sha"))
    alone = found.where("group_size is null").select("doc")
    top = found.where(F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.first("doc").alias("doc")).select("doc")
    rest = g.base.join(g.mixed, "digest", "left_semi").groupBy("text").agg(F.coalesce(F.max_by("doc", "doc_id"), F.first("doc")).alias("doc")).select("doc")
    return alone.unionByName(top).unionByName(rest).select("doc.*")
