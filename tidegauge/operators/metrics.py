"""Aggregates over events, for all requests and for each class.

Every table has a column ``cls``: a class, or null for all requests together. Rows are first counted by class and
key; totals are sums of those counts, so no event is counted twice over a shuffle. Order within the log (``ord``)
decides ties. Percentiles take ranks from histograms, whose size follows distinct values and not requests.
``cells`` counts for all tables of a report in one pass over the lines; nothing of a line's size is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.dialects.event import latency_ns
from tidegauge.functions.text import status_class

#: Verdicts that mean the tier behind wasn't asked.
HITS = ("HIT", "STALE", "UPDATING", "REVALIDATED", "REFRESHHIT", "ORIGINSHIELDHIT")
#: The order of status classes in a report.
STATUS_ORDER = ("2xx", "3xx", "4xx", "5xx", "1xx", "other")
MS_LIMIT = 2**31 - 1
#: Columns whose values a report counts.
LABELS = ("status_class", "cache", "term_state", "host")


def prepared(events: DataFrame, class_column: Column) -> DataFrame:
    """Events with cls, sec, ms (wait, clamped), lat_ns and status_class. Needs ``ord``."""
    lat = latency_ns()
    return events.withColumn("cls", class_column).withColumn("sec", F.unix_seconds("ts")).withColumn("lat_ns", lat).withColumn("ms", F.when(lat.isNotNull(), F.least(F.floor(lat / 1_000_000), F.lit(MS_LIMIT))).cast("bigint")).withColumn("status_class", status_class(F.col("status")))


def with_total(df: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """A table counted by (cls, keys) with the rows of all classes together (cls null) added."""
    total = df.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()]).withColumn("cls", F.lit(None).cast("string"))
    return df.select("cls", *keys, *sums).unionByName(total.select("cls", *keys, *sums))


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("client_identity")).alias("identified"),
        F.count("ms").alias("measured"), F.sum("lat_ns").alias("lat_sum_ns"), F.max("ms").alias("max_ms"), F.count("cache").alias("judged"), F.count_if(F.col("cache").isin(*HITS)).alias("hits"),
    ]


def _summed() -> dict[str, Column]:
    s = F.sum
    return dict(requests=s("requests"), bytes=s("bytes"), first_ts=F.min("first_ts"), last_ts=F.max("last_ts"), identified=s("identified"), measured=s("measured"), lat_sum_ns=s("lat_sum_ns"), max_ms=F.max("max_ms"), judged=s("judged"), hits=s("hits"))


def _path_measures() -> list[Column]:
    return [F.count_if(F.col("status").between(200, 299)).alias("ok"), F.count_if(F.col("status") >= 500).alias("fivexx"), F.min("ord").alias("first_ord")]


def cells(p: DataFrame, keep: Column | None = None) -> DataFrame:
    """kind, cls, num, label, and all sums: lines counted by each key a report has, in one scan and one shuffle.

    Kinds are ``second`` (num), ``wait`` (num: ms), ``path`` and the LABELS (label), of rows that ``keep`` lets in; and
    where p has parse_status, ``line`` (label), of all rows. A line gives a short row a key, which the map side sums up
    at once. A row that is null in a key isn't counted by it.
    """
    keep = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    no_num, no_label = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def cell(kind: str, when: Column, num: Column = no_num, label: Column = no_label, cls: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), (F.col("cls") if cls is None else cls).alias("cls"), num.alias("num"), label.alias("label")))

    keys = [cell("second", keep, num=F.col("sec")), cell("wait", keep & F.col("ms").isNotNull(), num=F.col("ms")), cell("path", keep, label=F.col("path"))]
    keys += [cell(c, keep & F.col(c).isNotNull(), label=F.col(c)) for c in LABELS]
    if "parse_status" in p.columns:
        keys.append(cell("line", F.lit(True), label=F.col("parse_status"), cls=no_label))
    used = ("ts", "status", "bytes", "client_identity", "cache", "ms", "lat_ns", "ord")
    each = p.select(*used, F.explode(F.array(*keys)).alias("__k")).where("__k is not null").select(*used, "__k.kind", "__k.cls", "__k.num", "__k.label")
    return each.groupBy("kind", "cls", "num", "label").agg(*_measures(), *_path_measures(), F.max("ord").alias("last_ord"))


def merged(cells: DataFrame) -> DataFrame:
    """Cells of several parts of a log (days, machines) added up; ``first_ord`` and ``last_ord`` have to compare over the parts."""
    sums = {**_summed(), "ok": F.sum("ok"), "fivexx": F.sum("fivexx"), "first_ord": F.min("first_ord"), "last_ord": F.max("last_ord")}
    return cells.groupBy("kind", "cls", "num", "label").agg(*[c.alias(n) for n, c in sums.items()])


@dataclass(frozen=True)
class Tables:
    """The tables of a report, from its cells; equal to those made of the events themselves."""

    cells: DataFrame

    def _of(self, kind: str) -> DataFrame:
        return self.cells.where(F.col("kind") == kind)

    def lines(self) -> DataFrame:
        return self._of("line").select(F.col("label").alias("parse_status"), F.col("requests").alias("count"))

    def summary(self) -> DataFrame:
        own = self._of("second").groupBy("cls").agg(*[c.alias(n) for n, c in _summed().items()])
        return with_total(own, [], **_summed()).where("requests > 0")

    def per_second(self) -> DataFrame:
        own = self._of("second").select("cls", F.col("num").alias("sec"), F.col("requests").alias("n"), "last_ord")
        return with_total(own, ["sec"], n=F.sum("n"), last_ord=F.max("last_ord"))

    def wait_histogram(self) -> DataFrame:
        return with_total(self._of("wait").select("cls", F.col("num").alias("ms"), F.col("requests").alias("n")), ["ms"], n=F.sum("n"))

    def label_counts(self, column: str) -> DataFrame:
        return with_total(self._of(column).select("cls", "label", F.col("requests").alias("n")), ["label"], n=F.sum("n"))

    def path_stats(self) -> DataFrame:
        own = self._of("path").select("cls", F.col("label").alias("path"), F.col("requests").alias("n"), "ok", "fivexx", "first_ord")
        return with_total(own, ["path"], n=F.sum("n"), ok=F.sum("ok"), fivexx=F.sum("fivexx"), first_ord=F.min("first_ord"))


def summary(p: DataFrame) -> DataFrame:
    """cls, requests, bytes, first_ts, last_ts, identified, measured (waits), lat_sum_ns, max_ms, judged, hits."""
    return with_total(p.groupBy("cls").agg(*_measures()), [], **_summed()).where("requests > 0")


def window_seconds(first: Column, last: Column) -> Column:
    """Whole seconds elapsed plus one; 0 without events."""
    return F.coalesce(F.floor((F.unix_micros(last) - F.unix_micros(first)) / 1_000_000) + 1, F.lit(0)).cast("bigint")


def per_second(p: DataFrame) -> DataFrame:
    """cls, sec, n, last_ord: requests of each second that has any."""
    own = p.groupBy("cls", "sec").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last_ord"))
    return with_total(own, ["sec"], n=F.sum("n"), last_ord=F.max("last_ord"))


def peaks(seconds: DataFrame) -> DataFrame:
    """cls, peak, peak_sec (the second that first reached it), busy_seconds."""
    most = seconds.groupBy("cls").agg(F.max("n").alias("peak"), F.count(F.lit(1)).alias("busy_seconds")).withColumnRenamed("cls", "__c")
    first = seconds.join(F.broadcast(most), F.col("cls").eqNullSafe(F.col("__c")) & (F.col("n") == F.col("peak"))).groupBy("cls", "peak", "busy_seconds")
    return first.agg(F.min_by("sec", "last_ord").alias("peak_sec")).select("cls", "peak", "peak_sec", "busy_seconds")


def _index(q: Column, size: Column) -> Column:
    """0-based nearest rank: q times the size, rounded half up, less one, within the values."""
    return F.least(F.greatest((q * size + F.lit(0.5)).cast("bigint") - 1, F.lit(0).cast("bigint")), size - 1)


def _at_ranks(histogram: DataFrame, value: str, wanted: DataFrame) -> DataFrame:
    """cls, q, value: the value at each wanted 0-based rank (cls, q, rank) of a histogram (cls, value, n)."""
    running = histogram.withColumn("cum", F.sum("n").over(Window.partitionBy("cls").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    w = wanted.select(F.col("cls").alias("__c"), "q", "rank")
    return running.join(F.broadcast(w), F.col("cls").eqNullSafe(F.col("__c")) & (F.col("cum") > F.col("rank"))).groupBy("cls", "q").agg(F.min(value).alias("value"))


def _each(quantiles: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))


def rate_percentiles(seconds: DataFrame, window: Column | int, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """cls, q, value: percentiles over all seconds of the window, those without requests counted as 0, unstored."""
    by_n = seconds.groupBy("cls", "n").agg(F.count(F.lit(1)).alias("seconds")).withColumnRenamed("n", "rate").withColumnRenamed("seconds", "n")
    size = by_n.groupBy("cls").agg(F.sum("n").alias("busy")).withColumn("w", window if isinstance(window, Column) else F.lit(window).cast("bigint"))
    ranks = size.withColumn("q", _each(quantiles)).withColumn("silent", F.greatest(F.col("w") - F.col("busy"), F.lit(0))).withColumn("idx", _index(F.col("q"), F.col("w")))
    ranks = ranks.withColumn("rank", F.when(F.col("idx") >= F.col("silent"), F.least(F.col("idx") - F.col("silent"), F.col("busy") - 1)))
    found = _at_ranks(by_n, "rate", ranks.where("rank is not null"))
    return found.unionByName(ranks.where("rank is null").select("cls", "q", F.lit(0).cast("bigint").alias("value")))


def wait_histogram(p: DataFrame) -> DataFrame:
    """cls, ms, n."""
    return with_total(p.where("ms is not null").groupBy("cls", "ms").agg(F.count(F.lit(1)).alias("n")), ["ms"], n=F.sum("n"))


def wait_percentiles(histogram: DataFrame, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """cls, q, value (ms): exact nearest-rank percentiles."""
    ranks = histogram.groupBy("cls").agg(F.sum("n").alias("size")).withColumn("q", _each(quantiles)).withColumn("rank", _index(F.col("q"), F.col("size")))
    return _at_ranks(histogram, "ms", ranks)


def tails(histogram: DataFrame, thresholds_ms: Sequence[int]) -> DataFrame:
    """cls, over_ms, place, n, share: waits strictly longer than each threshold."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(int(t)).cast("bigint").alias("over_ms")) for i, t in enumerate(thresholds_ms)]))
    return histogram.select("cls", "ms", "n", at.alias("t")).select("cls", "ms", "n", "t.place", "t.over_ms").groupBy("cls", "place", "over_ms").agg(F.sum(F.when(F.col("ms") > F.col("over_ms"), F.col("n")).otherwise(0)).alias("over"), F.sum("n").alias("size")).select("cls", "place", "over_ms", F.col("over").alias("n"), (F.col("over") / F.col("size")).alias("share"))


def label_counts(p: DataFrame, column: str, label: str = "label") -> DataFrame:
    """cls, label, n of a column's values that aren't null."""
    return with_total(p.where(F.col(column).isNotNull()).groupBy("cls", F.col(column).alias(label)).agg(F.count(F.lit(1)).alias("n")), [label], n=F.sum("n"))


def top_labels(counts: DataFrame, k: int, label: str = "label") -> DataFrame:
    """The k most frequent labels of each cls, ties by label; adds place from 1."""
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("n"), label))).where(F.col("place") <= k)


def path_stats(p: DataFrame) -> DataFrame:
    """cls, path, n, ok (2xx), fivexx (500 and above, no upper bound), first_ord."""
    own = p.groupBy("cls", "path").agg(F.count(F.lit(1)).alias("n"), *_path_measures())
    return with_total(own, ["path"], n=F.sum("n"), ok=F.sum("ok"), fivexx=F.sum("fivexx"), first_ord=F.min("first_ord"))


def cap_paths(paths: DataFrame, cap: int, classes: Sequence[str | None]) -> DataFrame:
    """The first ``cap`` paths seen of each cls. Tables within the cap come back as they are."""
    sizes = {r["cls"]: r["count"] for r in paths.groupBy("cls").count().collect()}
    if max(sizes.values(), default=0) <= cap:
        return paths
    out = None
    for c in classes:  # few: one limited sort each, never a sort of all paths in one task
        mine = paths.where(F.col("cls").eqNullSafe(F.lit(c)))
        part = mine.orderBy("first_ord", "path").limit(cap) if sizes.get(c, 0) > cap else mine
        out = part if out is None else out.unionByName(part)
    return out


def top_paths(paths: DataFrame, k: int) -> DataFrame:
    """The k most requested paths of each cls, ties by path; adds place."""
    return paths.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("n"), "path"))).where(F.col("place") <= k)


def top_5xx(paths: DataFrame, k: int) -> DataFrame:
    return paths.where("fivexx > 0").withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("fivexx"), "path"))).where(F.col("place") <= k)


def pools(paths: DataFrame, size: int, min_ok: float) -> DataFrame:
    """Replay candidates of each class: paths that answered 2xx often enough, most requested first; adds place."""
    fit = paths.where(F.col("cls").isNotNull() & (F.col("ok") / F.col("n") >= min_ok))
    return fit.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("n"), "path"))).where(F.col("place") <= size)
