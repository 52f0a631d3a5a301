"""Line dedup by overlapping three-line windows. DataFrame functions only.

Every three consecutive lines of a document are hashed. Over all documents the first occurrence of each window
(smallest document id, then position) stays; the lines of later ones are covered, overlapping covers merge into
spans, and the spans go. Counts of a window are combined before they move, so a window in every document is one row a task.

A window without any word is no window. Fewer than three lines: nothing is removed. Null text stays null, with 0
lines. A null doc_id comes after all others and is one document with all rows without an id; rows that repeat an
id are occurrences in one document, those with the same window at the same line being one occurrence. Other columns are ignored
(``dedup`` gives them back).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import materialize

WINDOW = 3
_LAST = 2**63 - 1


def line_windows(text: Column, size: int) -> Column:
    """array<struct<h1,h2,pos>> of the windows that hold a word: two independent hashes and the first line's position."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), x.rlike(r"[^\x20\x09-\x0D]").alias("w")))

    def windows(h: Column) -> Column:
        at = F.when(F.size(h) >= size, F.sequence(F.lit(0), F.size(h) - size)).otherwise(F.array().cast("array<int>"))
        some = F.filter(at, lambda i: F.exists(F.slice(h, i + 1, size), lambda x: x["w"]))
        return F.transform(some, lambda i: F.struct(F.xxhash64(F.transform(F.slice(h, i + 1, size), lambda x: x["a"])).alias("h1"), F.hash(F.transform(F.slice(h, i + 1, size), lambda x: x["b"])).alias("h2"), i.alias("pos")))

    return F.transform(F.array(hashed), windows)[0]


def covered_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """key, starts: for each document that loses lines, the sorted first lines of its later occurrences."""
    found = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key"), F.explode(line_windows(F.col(text_col), size)).alias("w")).select("key", "w.*")
    found = materialize(found, "windows")
    place = F.struct("key", "pos")
    firsts = materialize(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first"), "repeated")
    later = found.join(firsts, ["h1", "h2"]).where(F.struct("key", "pos") > F.col("first"))
    return materialize(later.groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("starts")), "covered")


def cut_lines(lines: Column, starts: Column, size: int = WINDOW) -> Column:
    """The lines outside all spans of ``size`` lines at the sorted starts."""
    kept = F.transform(starts, lambda p, i: F.struct(F.coalesce(F.get(starts, i - 1) + size, F.lit(0)).alias("b"), p.alias("e")))
    gaps = F.concat(kept, F.array(F.struct((F.element_at(starts, -1) + size).alias("b"), F.size(lines).alias("e"))))
    return F.flatten(F.transform(F.filter(gaps, lambda g: g["e"] > g["b"]), lambda g: F.slice(lines, g["b"] + 1, g["e"] - g["b"])))


def spans(starts: Column, size: int = WINDOW) -> Column:
    """array<struct<begin,end>> of removed lines, merged."""
    opens = F.filter(F.transform(starts, lambda p, i: F.when(F.coalesce(F.get(starts, i - 1) + size < p, F.lit(True)), p)), lambda p: p.isNotNull())
    ends = F.filter(F.transform(starts, lambda p, i: F.when(F.coalesce(p + size < F.get(starts, i + 1), F.lit(True)), p + size)), lambda p: p.isNotNull())
    return F.zip_with(opens, ends, lambda b, e: F.struct(b.cast("long").alias("begin"), e.cast("long").alias("end")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with the text cut and a struct ``__lines``: n_lines, n_removed, spans."""
    starts = covered_starts(docs, id_col, text_col, size).select(F.col("key").alias("__key"), F.col("starts").alias("__starts"))
    joined = docs.join(starts, F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)) == F.col("__key"), "left")
    lines = F.when(F.col(text_col).isNull(), F.array().cast("array<string>")).otherwise(F.split(F.col(text_col), "\n"))
    mine = F.filter("__starts", lambda p: p <= F.size(lines) - size)  # a shorter row of a repeated id has fewer
    return (
        joined.withColumn("__all", lines)
        .withColumn("__mine", F.when(F.size(mine) > 0, mine))
        .withColumn("__left", F.when(F.col("__mine").isNotNull(), cut_lines(F.col("__all"), F.col("__mine"), size)).otherwise(F.col("__all")))
        .withColumn("__lines", F.struct(F.size("__all").cast("long").alias("n_lines"), (F.size("__all") - F.size("__left")).cast("long").alias("n_removed"), F.coalesce(spans(F.col("__mine"), size), F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans")))
        .withColumn(text_col, F.when(F.col("__mine").isNull(), F.col(text_col)).otherwise(F.array_join("__left", "\n")))
        .drop("__key", "__starts", "__all", "__mine", "__left")
    )


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed, text (cut), spans."""
    out = dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", size)
    return out.select("doc_id", "__lines.n_lines", "__lines.n_removed", "text", "__lines.spans")
