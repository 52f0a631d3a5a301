"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

Every document's words (lower-cased for the ratio) give hashed unigrams and bigrams in a fixed number of buckets.
One pass counts the buckets over the whole corpus and over the trusted documents; smoothed, they are two
multinomials. A document's score is the sum over its n-grams of log p(trusted) - log p(raw), divided by their
number; it is kept if no plain rule fails it and the score reaches a fixed threshold. The bucket table has a fixed
size, whatever the corpus.

Null text has no words and fails the plain rules. Null doc_id is never trusted; repeated rows count each. Without
trusted documents every score is 0. Other columns are ignored (or, in ``accept``, come back as they were).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import BROADCAST_ROWS, materialize

#: Buckets of hashed n-grams, the mass added to each, and the least score kept (nats per n-gram).
BUCKETS, SMOOTHING, THRESHOLD = 1 << 14, 1.0, -0.25
#: Plain rules: fewer words fail; more than so many hundredths of the words in repeated windows fail.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]  # a second parameter of body must not be taken for an index


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more, from the words' hashes."""
    windows = F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(1), F.size(hashes) - size + 1), lambda i: F.xxhash64(F.slice(hashes, i, size)))).otherwise(F.array().cast("array<long>"))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ranked, lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = let(starts, lambda p: F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def grams(words: Column, buckets: int) -> Column:
    """0-based buckets of a document's unigrams, then its bigrams."""
    one = F.transform(words, lambda w: F.xxhash64(F.lower(w)))

    def both(h: Column) -> Column:
        two = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        return F.transform(F.concat(h, F.slice(two, 1, F.greatest(F.size(h) - 1, F.lit(0)))), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))

    return let(one, both)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of labelled documents of good quality that aren't toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__trusted")).distinct()


def weights(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, smoothing: float, broadcast_rows: int) -> DataFrame:
    """One row: w, the log ratio of each bucket. Counts cover all documents."""
    trusted = materialize(trusted, "trusted")
    if trusted.count() <= broadcast_rows:
        trusted = F.broadcast(trusted)
    words = docs.select(F.col(id_col).cast("long").alias("id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    marked = words.join(trusted, F.col("id") == F.col("__trusted"), "left").select(F.col("__trusted").isNotNull().cast("long").alias("t"), F.explode(grams(F.col("w"), buckets)).alias("g"))
    counts = materialize(marked.groupBy("g").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("r")), "grams")
    total = counts.agg(F.sum("t").alias("t"), F.sum("r").alias("r")).first()
    nt, nr = total["t"] or 0, total["r"] or 0
    slots = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("g")).join(counts, "g", "left")
    ratio = F.log((F.coalesce("t", F.lit(0)) + smoothing) / (nt + smoothing * buckets)) - F.log((F.coalesce("r", F.lit(0)) + smoothing) / (nr + smoothing * buckets))
    return slots.agg(F.transform(F.sort_array(F.collect_list(F.struct("g", (ratio if nt else F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("w"))


def measured(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with a struct column ``__quality`` of all counts, the score and the verdict."""
    docs = docs.withColumn("__w", materialize(weights(docs, trusted_ids(labels), id_col, text_col, buckets, smoothing, broadcast_rows), "weights").scalar())
    table = F.col("__w")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(w: Column) -> Column:
        n = F.size(w)
        dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        repeat = let(F.transform(w, lambda x: F.xxhash64(x)), repeated_words)
        score = let(grams(w, buckets), lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.size(g)).otherwise(F.lit(0.0)))
        return F.struct(n.cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"), repeat.alias("n_repeat_words"), score.alias("log_ratio"))

    def judged(q: Column) -> Column:
        failed = (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])
        return F.struct(*[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio")], failed.alias("base_failed"), (~failed & (q["log_ratio"] >= threshold)).alias("kept"))

    return docs.withColumn("__quality", let(let(words, counted), judged)).drop("__w")


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ratio, base_failed, kept."""
    return measured(docs, labels, id_col, **kw).select(F.col(id_col).cast("long").alias("doc_id"), "__quality.*")


def accept(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return measured(docs, labels, **kw).where("__quality.kept").drop("__quality")
