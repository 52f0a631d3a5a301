"""What the training-data operators share: scratch tables, word hashing and Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a per-worker word cache holds before it starts over; bounds worker memory.
WORD_CACHE = 600_000
#: Rows of a side that may be broadcast (a long key each); larger sides are shuffled.
BROADCAST_ROWS = 2_000_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder. Only in one JVM may that be a local one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidegauge/{name}-{uuid.uuid4().hex}"


#: Folder of each written table, for ``discard``.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*written: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more, through Hadoop's file system interface."""
    for df in written:
        if path := _WRITTEN.pop(df, None):
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def join_spread(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, spread: Column, heavy: int = 2000, salts: int = 1024) -> DataFrame:
    """``left`` with the columns of ``right`` (a row a key; ``weight``: how many left rows hold it) or nulls, by one pass over left.

    A key that more than one in ``heavy`` of ``total`` left rows hold is heavy: there are fewer than ``heavy`` of those, so
    they are broadcast, and their left rows are dealt over ``salts`` by ``spread`` instead of by key. No other key is large.
    """
    values = [c for c in right.columns if c != key]
    most = max(1, total // heavy)
    named = lambda df, mark: df.select(key, *[F.col(c).alias(f"__{mark}_{c}") for c in values])
    found = left.join(F.broadcast(named(right.where(F.col(weight) > most), "h")), key, "left")
    found = found.withColumn("__salt", F.when(F.col(f"__h_{weight}").isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0).cast("long")))
    light = named(right.where(F.col(weight) <= most), "l").withColumn("__salt", F.pmod(F.col(f"__l_{weight}").cast("long"), F.lit(1).cast("long")))  # 0, as a value of the row
    both = found.join(light, [key, "__salt"], "left")
    return both.select(*left.columns, *[F.coalesce(f"__h_{c}", f"__l_{c}").alias(c) for c in values])


def hash_parts(spark: SparkSession, factor: int = 4) -> int:
    """Number of hash ranges that large groupings are dealt into; follows the session's shuffle parallelism."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class IdCache(dict):
    """word bytes -> the next free id."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


#: Multiplier of the rolling word hash, its inverse modulo 2**64, and the bytes hashed in one step.
_BASE = 0x9E3779B97F4A7C15
_INVERSE, _SLICE = pow(_BASE, -1, 1 << 64), 1 << 20
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(x), np.uint64)], dtype=np.uint64) for x in (_BASE, _INVERSE)]
    return _POWERS


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words between ASCII white space."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACES[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, begin and end of each word between ASCII white space.

    A word's hash is a polynomial of its bytes modulo 2**64, read off running sums over the text, then mixed.
    """
    begin, end = word_spans(text)
    out = np.empty(len(begin), np.uint64)
    raw, at = np.frombuffer(text, np.uint8), 0
    while at < len(begin):  # in slices of whole words
        stop = max(at + 1, int(np.searchsorted(end, begin[at] + _SLICE, side="right")))
        lo, hi = begin[at], end[stop - 1]
        power, inverse = _powers(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[raw[lo:hi]] * power[: hi - lo], out=sums[1:])
        b, e = begin[at:stop] - lo, end[at:stop] - lo
        out[at:stop] = (sums[e] - sums[b]) * inverse[b]
        at = stop
    return mix64(out + (end - begin).astype(np.uint64)), begin, end


def released(step):
    """A batch iterator function whose worker gives freed memory back to the system when its task is over."""

    @functools.wraps(step)
    def run(*args, **kw):
        try:
            yield from step(*args, **kw)
        finally:
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def text_slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
