"""Mixing sources to target weights.

Token counts of the cells (source, language, topic) are raked by iterative proportional fitting until their
marginals equal the targets. No cell may weigh more than its tokens at the token budget, so the fit is one under upper
bounds: a cell that reaches its bound stays there and the others make up for it. Weight times budget over tokens is
a cell's probability (at most 1), and a document is drawn when a hash of its id falls below it. Cells are aggregated
before anything moves. Up to ``max_cells`` cells are fitted on the driver and broadcast; more are fitted by DataFrame
steps and joined by a shuffle, with the same result.

Topics, unless a topic column is given, are clusters (k-means over all documents, started by hashes of rows and summed in
whole numbers, so alike for any dealing of the same rows) of the writing's make-up: shares of letters, digits,
punctuation, symbols and line breaks, word and line lengths, size. They cut across languages, and look at no word.

Targets: sources and topics by their share of the tokens to a power, which lifts the small ones; languages as given.
Targets for categories without tokens are left out and the others scaled; categories without a target keep their
share. A category can't get more than it holds: its target is cut to that, and the others scaled. Where no weights meet all margins at once, all targets move towards the
present shares by the least quarter with which they can be met (``Plan.blend``); with the present shares they always can.

A null source, language or topic is the category "unknown". Null or empty text has no tokens: it has no weight of its
own and takes its cell's probability, and a cell of such documents alone has probability 0. Rows that repeat an id are
drawn together; a null id is drawn by its text. A text of any length is read whole. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidegauge.llm.common import discard, materialize, text_slices

MAX_CELLS = 100_000
ROUNDS, TOLERANCE = 2000, 1e-9
#: Part of the tokens to draw, and the powers that flatten the shares of sources and of topics.
FRACTION, FLATTEN, TOPIC_FLATTEN = 0.6, 0.7, 0.9
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
TOPICS, TOPIC_ROUNDS, TOPIC_SEED = 8, 10, 5
#: Rows that centres may start from (all rows move them afterwards), and what a feature of 1 is as a whole number.
STARTS, SCALE = 512, 1 << 20
BLENDS = (0.0, 0.25, 0.5, 0.75, 1.0)
DIMS = ("source", "lang", "topic")
#: Bytes of text looked at together.
SLICE_BYTES = 4_000_000

#: Kinds of bytes that a text's make-up counts; 0: lower-case letters and all else.
_KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:!?", b"()[]{}\"'`", b"#*$%&|<>=_+~^@\\/-"), 1):
    _KINDS[list(_bytes)] = _kind
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FEATURES = 10


def make_up(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words (between ASCII white space) of each text, and its features, each about from 0 to 1."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    size = np.diff(np.r_[0, ends])
    raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    n = len(size)
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    kinds = np.bincount(doc * np.int64(8) + _KINDS[raw], minlength=8 * n).reshape(n, 8)
    space = _SPACES[raw]
    begins = ~space
    begins[1:] &= space[:-1] | (doc[1:] != doc[:-1])
    words = np.bincount(doc[begins], minlength=n)
    letters = np.bincount(doc[~space], minlength=n)
    some = np.maximum(size, 1)[:, None]
    per = lambda a, b: a / np.maximum(b, 1)
    more = np.stack([np.minimum(per(letters, words) / 12, 1), np.log2(words + 1) / 16, np.minimum(np.log2(per(words, kinds[:, 4] + 1) + 1) / 10, 1)], 1)
    return words, np.concatenate([np.sqrt(kinds[:, 1:] / some), more], 1)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """Features as whole numbers, whose sums don't depend on their order."""
    return np.rint(x * SCALE).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """source, lang, topic, n, x of (source, lang, topic, text)."""
    for batch in (part for b in batches for part in text_slices(b, 3, SLICE_BYTES)):
        n, x = make_up(batch.column(3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(list(whole_numbers(x)), pa.list_(pa.int64()))], names=[*DIMS, "n", "x"])


def first_centres(rows: np.ndarray, topics: int) -> np.ndarray:
    """Centres to start from: the first row, then always the row farthest from all chosen, the first of equal ones."""
    chosen = [0]
    far = ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < topics and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen].astype(float)


def _sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """topic, n, x: how many rows of a task are nearest to each centre, and their features' sums."""
    n, sums = np.zeros(len(centres), np.int64), np.zeros((len(centres), FEATURES), np.int64)
    for batch in batches:
        x = batch.column(0).flatten().to_numpy().reshape(-1, FEATURES)
        at = topic_of(x, centres)
        n += np.bincount(at, minlength=len(n))
        for i in range(FEATURES):
            np.add.at(sums[:, i], at, x[:, i])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))], names=["topic", "n", "x"])


def fit_topics(features: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS, seed: int = TOPIC_SEED) -> np.ndarray:
    """Centres of the topics over all rows with words, in a fixed order: Lloyd's rounds from ``STARTS`` rows at most.

    Rows start by the hash of their features and sums are of whole numbers, so equal rows give equal centres however they
    are dealt over files and tasks. A round gives the driver a row a topic.
    """
    rows = features.where("n > 0").select("x")
    some = rows.select("x", F.xxhash64(F.lit(seed), "x").alias("h")).groupBy("h", "x").agg(F.count(F.lit(1))).orderBy("h", "x").limit(STARTS).collect()
    if not some:
        return np.zeros((1, FEATURES))
    centres = first_centres(np.array([r["x"] for r in some], np.int64), topics)
    for _ in range(rounds):
        parts = rows.mapInArrow(partial(_sums, centres=centres), "topic int, n long, x array<long>")
        total = parts.groupBy("topic").agg(F.sum("n").alias("n"), *[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(FEATURES)]).collect()
        last, centres = centres, centres.copy()
        for r in total:
            if r["n"]:
                centres[r["topic"]] = [r[f"x{i}"] / r["n"] for i in range(FEATURES)]
        if (last == centres).all():
            break
    return np.array(sorted(centres.tolist()))


def topic_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row of whole numbers, the first of equal ones."""
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2).argmin(1)


def _assign(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The topic in the third column by the features in the last, which goes."""
    for batch in batches:
        x = batch.column(4).flatten().to_numpy().reshape(-1, FEATURES)
        names = pa.array([f"topic-{t}" for t in topic_of(x, centres).tolist()])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], names, batch.column(3)], names=[*DIMS, "n"])


def _annotate(batches: Iterator[pa.RecordBatch], text_at: int, centres: np.ndarray | None, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Each row with its number of words and its topic."""
    for batch in (part for b in batches for part in text_slices(b, text_at, SLICE_BYTES)):
        n, x = make_up(batch.column(text_at))
        names = pa.nulls(len(n), pa.string()) if centres is None else pa.array([f"topic-{t}" for t in topic_of(whole_numbers(x), centres).tolist()])
        out = batch.append_column("__n", pa.array(n, pa.int64())).append_column("__topic", names)
        yield out if keep_text else out.remove_column(text_at)


def targets_of(shares: Mapping[str, float], wanted: Mapping[str, float] | None, power: float | None = None) -> dict[str, float]:
    """Target shares over the categories that have tokens: wanted ones as given, others in proportion to what is left of their share."""
    have = {k: v for k, v in shares.items() if v > 0}
    if power is not None:
        raw = {k: v**power for k, v in have.items()}
    else:
        wanted = {k: v for k, v in (wanted or {}).items() if k in have}
        rest = sum(v for k, v in have.items() if k not in wanted)
        given = sum(wanted.values()) or 1.0
        raw = {k: wanted[k] / given * (1 - rest) if k in wanted else v for k, v in have.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else {}


def within(target: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Shares no larger than ``most`` (whose sum is at least 1); what is cut goes to the others in proportion."""
    out, full = target.astype(float), np.zeros(len(target), bool)
    while (over := (out > most) & ~full).any():
        full |= over
        out[full] = most[full]
        left = out[~full].sum()
        if left > 0:
            out[~full] *= (1 - most[full].sum()) / left
    return out


def _fit(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int, tolerance: float, caps: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    raw = tokens / tokens.sum()
    caps = np.full(len(raw), np.inf) if caps is None else caps
    off = np.inf
    for _ in range(rounds):
        off = 0.0
        for c, t in zip(codes, targets):
            now = np.bincount(c, np.minimum(raw, caps), len(t))
            off = max(off, float(np.abs(now - t).max()))
            raw = raw * np.divide(t, now, out=np.zeros(len(t)), where=now > 0)[c]
        if off < tolerance:
            break
    return np.minimum(raw, caps), off


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE, caps: np.ndarray | None = None) -> np.ndarray:
    """Weights (summing to 1) whose marginals are the targets, nearest to the given tokens in relative entropy and at most ``caps``."""
    w = _fit(tokens, codes, targets, rounds, tolerance, caps)[0]
    return w / w.sum()


def calibrate(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, k * weight / tokens) whose expected tokens are the budget (all, if it isn't less than there is)."""
    if budget >= tokens.sum():
        return np.ones(len(tokens))
    ratio = weights / tokens
    order = np.argsort(-ratio, kind="stable")
    full = np.r_[0, np.cumsum(tokens[order])[:-1]]
    rest = np.cumsum(weights[order][::-1])[::-1]
    k = (budget - full) / rest
    i = int(np.argmax(k * ratio[order] <= 1)) if (k * ratio[order] <= 1).any() else len(k) - 1
    return np.minimum(1.0, np.maximum(0.0, k[i] * ratio))


@dataclass
class Plan:
    """A fit: ``p`` of each cell (or a table of them), the target shares used by dimension, and how far they had to move."""

    p: np.ndarray | DataFrame
    targets: list
    blend: float


def plan_cells(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], fraction: float = FRACTION, rounds: int = ROUNDS) -> Plan:
    """Probabilities of cells that draw ``fraction`` of the tokens and meet the goals, moved as little as need be."""
    total = tokens.sum()
    budget = min(fraction, 1.0) * total
    if fraction >= 1:
        return Plan(np.ones(len(tokens)), [np.bincount(c, tokens / total, len(g)) for c, g in zip(codes, goals)], 1.0)
    shares = [np.bincount(c, tokens / total, len(g)) for c, g in zip(codes, goals)]
    for blend in BLENDS:
        targets = [within((1 - blend) * g + blend * s, s * total / budget) for g, s in zip(goals, shares)]
        w, off = _fit(tokens, codes, targets, rounds, TOLERANCE, tokens / budget)
        if off < TOLERANCE:
            break
    return Plan(np.clip(w * budget / tokens, 0.0, 1.0), targets, blend)


def _margin(cells: DataFrame, dim: str, weight: Column) -> DataFrame:
    return cells.groupBy(dim).agg(F.sum(weight).alias("__have"))


def _plan_table(cells: DataFrame, goals: list[DataFrame], fraction: float, rounds: int, total: float) -> Plan:
    """``plan_cells`` by joins and sums, for cell tables of any size; each round is written out.

    ``goals``: tables of category, share and goal.
    """
    budget = min(fraction, 1.0) * total
    if fraction >= 1:
        return Plan(cells.withColumn("p", F.lit(1.0)), goals, 1.0)
    cap = F.col("tokens") / F.lit(budget)
    for blend in BLENDS:
        targets = [_within_table(g.withColumn("__want", (1 - blend) * F.col("goal") + blend * F.col("share")).withColumn("most", F.col("share") * F.lit(total / budget))) for g in goals]
        now, off = cells.withColumn("raw", F.col("tokens") / F.lit(total)), None
        for _ in range(rounds):
            off = 0.0
            for d, t in zip(DIMS, targets):
                have = materialize(_margin(now, d, F.least("raw", cap)).join(t, d), "margin")
                off = max(off, have.agg(F.max(F.abs(F.col("__have") - F.col("__want")))).first()[0] or 0.0)
                now = now.join(have, d).withColumn("raw", F.when(F.col("__have") > 0, F.col("raw") * F.col("__want") / F.col("__have")).otherwise(0.0)).drop("__have", "__want")
            last, now = now, materialize(now, "raked")
            if off < TOLERANCE:
                break
        if off < TOLERANCE:
            break
    return Plan(now.withColumn("p", F.least(F.lit(1.0), F.least("raw", cap) * F.lit(budget) / F.col("tokens"))), targets, blend)


def _within_table(goal: DataFrame) -> DataFrame:
    """``within`` over a table of category, __want and most."""
    name = goal.columns[0]
    goal = materialize(goal.select(name, "__want", "most", F.lit(False).alias("full")), "within")
    while not goal.where("not full and __want > most").isEmpty():
        marked = goal.withColumn("full", F.expr("full or __want > most"))
        left, held = marked.agg(F.sum(F.when(~F.col("full"), F.col("__want"))), F.sum(F.when(F.col("full"), F.col("most")))).first()
        scale = (1 - (held or 0.0)) / left if left else 1.0
        goal = materialize(marked.withColumn("__want", F.when(F.col("full"), F.col("most")).otherwise(F.col("__want") * F.lit(scale))), "within")
    return goal.select(name, "__want")


def _goal_tables(cells: DataFrame, total: float, wanted: tuple, powers: tuple) -> list[DataFrame]:
    """Category, share and goal by dimension: ``targets_of`` by joins and sums."""
    spark, goals = cells.sparkSession, []
    for d, given, power in zip(DIMS, wanted, powers):
        share = cells.groupBy(d).agg((F.sum("tokens") / F.lit(total)).alias("share"))
        if power is not None:
            raw = share.withColumn("r", F.pow("share", F.lit(power)))
        else:
            marked = materialize(share.join(spark.createDataFrame([(k, float(v)) for k, v in (given or {}).items()], f"{d} string, g double"), d, "left"), "share")
            rest, sums = (x or 0.0 for x in marked.agg(F.sum(F.when(F.col("g").isNull(), F.col("share"))), F.sum("g")).first())
            raw = marked.withColumn("r", F.when(F.col("g").isNull(), F.col("share")).otherwise(F.col("g") / F.lit(sums or 1.0) * F.lit(1 - rest)))
        sum_ = raw.agg(F.sum("r")).first()[0]
        goals.append(materialize(raw.select(d, "share", (F.col("r") / F.lit(sum_)).alias("goal")), "goal"))
    return goals


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, languages: Mapping[str, float] | None = LANGUAGES, topics: Mapping[str, float] | None = None, flatten: float = FLATTEN, topic_flatten: float | None = TOPIC_FLATTEN, fraction: float = FRACTION, seed: int = 17, max_cells: int = MAX_CELLS, rounds: int = ROUNDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct column ``__mix``: source, lang, topic, n_tokens, probability, sampled, blend (of ``Plan``; 1: the shares as they are).

    ``topics``: target shares by topic, in place of ``topic_flatten``. Without ``keep_text`` the text column goes.
    """
    key = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    text = F.col(text_col).cast("binary")
    named = [key(F.col(source_col)).alias("source"), key(F.col(lang_col)).alias("lang"), (key(F.col(topic_col)) if topic_col else F.lit(None).cast("string")).alias("topic")]
    features = materialize(docs.select(*named, text.alias("text")).mapInArrow(_features, "source string, lang string, topic string, n long, x array<long>"), "make-up")
    centres = None if topic_col else fit_topics(features)
    counted = features.select(*DIMS, "n") if topic_col else features.mapInArrow(partial(_assign, centres=centres), "source string, lang string, topic string, n long")
    cells = materialize(counted.groupBy(*DIMS).agg(F.sum("n").alias("tokens")).where("tokens > 0"), "cells")
    discard(features)
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    wanted, powers = (None, languages, topics), (flatten, None, None if topics else topic_flatten)
    if n <= max_cells:
        table = cells.orderBy(*DIMS).collect()
        rows, blend = [], 0.0
        if table:
            tokens = np.array([r["tokens"] for r in table], float)
            names = [sorted({r[d] for r in table}) for d in DIMS]
            codes = [np.searchsorted(np.array(x, object), np.array([r[d] for r in table], object)) for x, d in zip(names, DIMS)]
            shares = [dict(zip(x, np.bincount(c, tokens / tokens.sum(), len(x)))) for x, c in zip(names, codes)]
            goals = [targets_of(s, w, p) for s, w, p in zip(shares, wanted, powers)]
            plan = plan_cells(tokens, codes, [np.array([g[k] for k in x]) for g, x in zip(goals, names)], fraction, rounds)
            blend = plan.blend
            rows = [(*(r[d] for d in DIMS), float(p)) for r, p in zip(table, plan.p)]
        chances = F.broadcast(docs.sparkSession.createDataFrame(rows, "source string, lang string, topic string, p double"))
    else:
        plan = _plan_table(cells, _goal_tables(cells, float(total), wanted, powers), fraction, rounds, float(total))
        chances, blend = materialize(plan.p.select(*DIMS, "p"), "chances"), plan.blend
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(1 << 53)) / F.lit(float(1 << 53))
    placed = docs.withColumn("__spot", spot)
    kept = [f for f in placed.schema.fields if keep_text or f.name != text_col]
    schema = StructType([*kept, StructField("__n", LongType()), StructField("__topic", StringType())])
    seen = placed.mapInArrow(partial(_annotate, text_at=placed.columns.index(text_col), centres=centres, keep_text=keep_text), schema)
    topic = key(F.col(topic_col)) if topic_col else F.col("__topic")
    chances = chances.select(*[F.col(d).alias(f"__{d}_") for d in DIMS], F.col("p").alias("__p"))
    own = dict(zip(DIMS, (key(F.col(source_col)), key(F.col(lang_col)), topic)))
    joined = seen.join(chances, [own[d] == F.col(f"__{d}_") for d in DIMS], "left")
    p = F.coalesce("__p", F.lit(0.0))
    struct = F.struct(*(c.alias(d) for d, c in own.items()), F.col("__n").alias("n_tokens"), p.alias("probability"), (F.col("__spot") < p).alias("sampled"), F.lit(blend).alias("blend"))
    return joined.withColumn("__mix", struct).drop("__p", "__n", "__topic", "__spot", *[f"__{d}_" for d in DIMS])


def mixed_report(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, sampled, blend, a row per document."""
    return mix(docs, id_col, keep_text=False, **kw).select(F.col(id_col).cast("long").alias("doc_id"), "__mix.*")


def sample(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that are drawn."""
    return mix(docs, **kw).where("__mix.sampled").drop("__mix")
