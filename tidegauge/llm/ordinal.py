"""Quality classifier: cumulative-link (ordered logistic) regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector over hashed text features for all grades and
ordered thresholds. Features are the distinct words of a text (ASCII letters lowered, cut at other ASCII signs)
and coarse marks of its shape, hashed to buckets. It is fitted by full-batch gradient steps on the driver over a bounded
sample of rated documents (``max_rows``, drawn by a hash of the id; the only bound), then scores every document:
expected grade, and the tail probability of the highest grade, which selects (from ``keep_tail`` on, itself included).

Null text is empty text. Ratings without a grade or document, and null ids, are left out; a document with several
ratings has the lowest. Without ratings in at least two grades every document gets the prior and the threshold decides on that. Repeated
rows score alike. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import table
from tidegauge.llm.fm_index import words_of

BUCKETS, MAX_ROWS, KEEP_TAIL = 1 << 17, 12_000, 0.6
ROUNDS, RIDGE, LEAST_DOCS = 150, 2e-4, 3
GRADES = 3


def grade_column() -> Column:
    """0 toxic, 1 poor, 2 good, of a labels row (null where the quality is unknown and the text isn't toxic)."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


class BucketCache(dict):
    """word -> bucket; starts over when it is full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
        value = self[word] = zlib.crc32(word) % self.buckets
        return value


_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>!_=+~^@{}[]\\"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))


def shape(text: bytes, words: list[bytes], distinct: int) -> list[bytes]:
    """Marks of the text's shape; no word holds a zero byte."""
    raw = np.frombuffer(text, np.uint8)
    n, m = max(1, len(raw)), max(1, len(words))
    steps = lambda x, *edges: sum(x >= e for e in edges)
    return [b"\0s%d" % steps(_SYMBOLS[raw].sum() / n, 0.005, 0.02, 0.05, 0.1, 0.2), b"\0u%d" % steps(_UPPER[raw].sum() / n, 0.05, 0.15, 0.4), b"\0d%d" % steps(distinct / m, 0.05, 0.15, 0.3, 0.5, 0.8), b"\0n%d" % steps(m, 5, 20, 50, 200, 1000, 4000), b"\0l%d" % steps(text.count(b"\n") / m, 0.01, 0.05, 0.2), b"\0w%d" % steps(n / m, 3, 5, 7, 9, 12)]


def features(text: bytes | None, cache: BucketCache) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    words = words_of(text)
    kinds = set(words)
    kinds.update(shape(text or b"", words, len(kinds)))
    return np.unique(np.fromiter(map(cache.__getitem__, kinds), np.int32, len(kinds)))


_SAMPLE = pa.schema([("id", pa.int64()), ("grade", pa.int32()), ("x", pa.binary())])


def _vectors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    cache = BucketCache(buckets)
    for batch in batches:
        yield table({"id": batch.column(0), "grade": batch.column(1), "x": [features(t, cache).tobytes() for t in batch.column(2).to_pylist()]}, _SAMPLE)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        lens = np.array([len(r) for r in rows], np.int64)
        return np.add.reduceat(self.weights[flat], np.cumsum(lens) - lens) if len(flat) else np.zeros(len(rows))

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) for each threshold k, a row per document."""
        return sigmoid(self.margins(rows)[:, None] - self.thresholds[None, :])


def fit(rows: list[np.ndarray], grades: np.ndarray, buckets: int = BUCKETS, n_grades: int = GRADES, rounds: int = ROUNDS, ridge: float = RIDGE, least_docs: int = LEAST_DOCS) -> Model:
    """Maximum likelihood with a ridge, by Adam over the whole sample; thresholds stay ordered by positive gaps."""
    n = len(rows)
    share = np.array([(np.sum(grades <= k) + 0.5) / (n + 1) for k in range(n_grades - 1)])
    cut = np.log(share / (1 - share))
    if n == 0 or len(np.unique(grades)) < 2:
        return Model(np.zeros(buckets), cut)
    lens = np.array([len(r) for r in rows], np.int64)
    flat, doc = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(n), lens)
    on = np.bincount(flat, minlength=buckets)[flat] >= least_docs  # rarer buckets can only tell single documents apart
    flat, doc = flat[on], doc[on]
    w = np.zeros(buckets)
    gaps = np.log(np.maximum(np.diff(cut), 1e-3))
    params = np.r_[cut[0], gaps]
    m, v, mp, vp = np.zeros(buckets), np.zeros(buckets), np.zeros(len(params)), np.zeros(len(params))
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.r_[params[0], np.exp(params[1:])])
        z = np.bincount(doc, w[flat], n)
        edges = np.c_[np.full(n, -np.inf), np.tile(theta, (n, 1)), np.full(n, np.inf)] - z[:, None]
        cdf = sigmoid(np.clip(edges, -40, 40))
        cdf[:, 0], cdf[:, -1] = 0, 1
        pdf = cdf * (1 - cdf)
        i = np.arange(n)
        p = np.maximum(cdf[i, grades + 1] - cdf[i, grades], 1e-12)
        dz = (pdf[i, grades + 1] - pdf[i, grades]) / p / n  # of the negative log likelihood
        dtheta = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            dtheta[k] = (-(pdf[:, k + 1] / p)[grades == k].sum() + (pdf[:, k + 1] / p)[grades == k + 1].sum()) / n
        gw = np.bincount(flat, dz[doc], buckets) + ridge * w
        tail = np.cumsum(dtheta[::-1])[::-1]
        gp = np.r_[tail[0], tail[1:] * np.exp(params[1:])]
        for x, g, a, b, rate in ((w, gw, m, v, 0.05), (params, gp, mp, vp, 0.05)):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)
    return Model(w, np.cumsum(np.r_[params[0], np.exp(params[1:])]))


_SCORED = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("grade_probabilities", pa.list_(pa.float64())), ("kept", pa.bool_())])


def _score(batches: Iterator[pa.RecordBatch], model: Model, keep_tail: float) -> Iterator[pa.RecordBatch]:
    cache = BucketCache(len(model.weights))
    for batch in batches:
        tails = model.tails([features(t, cache) for t in batch.column(1).to_pylist()])
        full = np.c_[np.ones(len(tails)), tails, np.zeros(len(tails))]
        yield table({"doc_id": batch.column(0), "expected_grade": tails.sum(1), "tail_probability": tails[:, -1], "grade_probabilities": (full[:, :-1] - full[:, 1:]).tolist(), "kept": tails[:, -1] >= keep_tail}, _SCORED)


def rated_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature rows and grades of at most ``max_rows`` rated documents."""
    grades = labels.select(F.col(id_col).cast("long").alias("__rated"), grade_column().alias("__grade")).where("__rated is not null and __grade is not null").groupBy("__rated").agg(F.min("__grade").alias("__grade"))
    chosen = grades.orderBy(F.xxhash64("__rated"), "__rated").limit(max_rows)  # a fixed bound, so it can be broadcast
    rated = docs.join(F.broadcast(chosen), docs[id_col] == chosen["__rated"]).select(F.col("__rated").alias("id"), F.col("__grade").cast("int").alias("grade"), F.col(text_col).cast("binary").alias("text"))
    vectors = rated.mapInArrow(partial(_vectors, buckets=buckets), "id long, grade int, x binary")
    rows = vectors.orderBy("id", "x").limit(max_rows).collect()  # rows that repeat an id are cut before they come here
    return [np.frombuffer(bytes(r["x"]), np.int32) for r in rows], np.array([r["grade"] for r in rows], np.int64)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, keep_tail: float = KEEP_TAIL, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the highest grade), grade_probabilities, kept: a row per document."""
    model = fit(*rated_sample(docs, labels, id_col, text_col, max_rows, buckets), buckets=buckets)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return base.mapInArrow(partial(_score, model=model, keep_tail=keep_tail), "doc_id long, expected_grade double, tail_probability double, grade_probabilities array<double>, kept boolean")
