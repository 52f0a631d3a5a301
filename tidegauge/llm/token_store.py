"""Token-id shards with a minimal perfect hash index.

Texts are encoded where they lie, and only their packed ids are dealt out in key order (doc_id; nulls first, equal keys
by the first 64 characters of their texts, then by a hash of the whole) and cut into shards of whole documents. A
shard is one record of a Parquet table written by Spark, so it is committed whole, can lie in any store that Spark
writes, and survives lost executors; it has a row group of its own, so single shards can be read:

    shard, base           number, by writing task and place; ids that the task wrote before it
    first_key, last_key   the shard's key range (absent keys: the least long)
    ids                   raw little-endian ids of its documents, 2 bytes each if the vocabulary fits, else 4
    width                 2 or 4
    n_ids, n_docs         totals; n_keyless: documents without a key, which come first
    levels                the perfect hash: for each level, its size in bits (u32), then all bit arrays
    fingerprints          u32 of each slot's key
    offsets, lengths      u64 each slot: first id in the shard, number of ids of all its documents with that key
    doc_starts            u64 for each document in order: first id in the shard (tells equal keys apart)
    keys                  i64 for each document in order (absent keys: the least long)

A key's slot is found in constant time: level by level, the first level where its bit is set gives the slot as the
rank of that bit; the fingerprint then tells foreign keys. A key with more documents than a shard holds goes on in
the next ones, so equal keys (null ones too) never make a record too large.

Null text is encoded as empty: the end id alone. Other columns are ignored. An empty table gives no shard.
Special tokens' strings in a text are ordinary text (``encode_special_tokens``, as the notes of the vocabularies have it),
so the tokenizer gives no special id.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial, reduce
from itertools import islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import BROADCAST_ROWS, materialize, mix64, released, scratch_path, table, text_slices

#: Ids after which a shard is closed; a longer document has a shard of its own.
SHARD_IDS = 4_000_000
GAMMA, MAX_LEVELS = 2.0, 48
#: Bytes of text encoded at a time, and repeated words that a worker remembers.
SLICE_BYTES, COMMON_WORDS = 12_000_000, 120_000
#: Places sampled for each key range.
SAMPLED = 40
#: Characters of a text by which equal keys are ordered before a hash of the whole decides.
HEAD = 64
NO_KEY = -(2**63)
_NUMBERS, _BYTES = ("shard", "base", "first_key", "last_key", "n_ids", "n_docs", "n_keyless"), ("levels", "fingerprints", "offsets", "lengths", "doc_starts", "keys", "ids")
LAYOUT = ", ".join([*(f"{c} long" for c in _NUMBERS), "width int", *(f"{c} binary" for c in _BYTES)])
_SHARD = pa.schema([*((c, pa.int64()) for c in _NUMBERS), ("width", pa.int32()), *((c, pa.binary()) for c in _BYTES)])


class PerfectHash:
    """Levels of bit arrays: a key rests at the first level where it alone has its bit."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        counts = [int(b.sum()) for b in bits]
        self.base = np.cumsum([0, *counts])
        self.rank = [np.cumsum(b) - b for b in (x.astype(np.int64) for x in bits)]

    @staticmethod
    def spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        bits, left = [], keys
        while len(left):
            if len(bits) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, int(GAMMA * len(left)))
            at = cls.spot(left, len(bits), size)
            once = np.bincount(at, minlength=size) == 1
            bits.append(once)
            left = left[~once[at]]
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level holds it; foreign keys may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        for level, b in enumerate(self.bits):
            open_ = np.flatnonzero(out < 0)
            at = self.spot(keys[open_], level, len(b))
            hit = b[at]
            out[open_[hit]] = self.base[level] + self.rank[level][at[hit]]
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.bits), *map(len, self.bits)], "<u4").tobytes() + b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw[:4], "<u4")[0])
        sizes, at, bits = np.frombuffer(raw[4 : 4 + 4 * n], "<u4").tolist(), 4 + 4 * n, []
        for s in sizes:
            width = (s + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(raw[at : at + width], np.uint8), count=s).astype(bool))
            at += width
        return cls(bits)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")


#: White space of any kind twice in a row, a space at the end, or the mark of a line's first word: such texts are encoded whole.
_SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TIGHT = rf"{_SPACE}{{2}}| \z|\x00"
_FIRST = "\0"


class Encoder:
    """Whole texts to packed ids.

    The tokenizer begins a new pre-token at a space between two non-spaces, and gives a line break between two
    non-spaces one of its own. Between those, words are independent: the words of a slice of texts become a
    dictionary, each entry is encoded once, and ids are gathered by entry. Texts with other white space runs are
    encoded as they are. A bounded number of repeated words is remembered.
    """

    def __init__(self, tokenizer_file: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle pool threads would spin on it
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = {2: "<u2", 4: "<u4"}[width]
        self.width = width
        self.line = self.whole("\n")
        self.fixed = {"\n": self.line, _FIRST: b"", "": b""}
        self.known: dict[str, bytes] = {}
        size = self.tok.get_vocab_size()
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(size)])  # \u0120 stands for a space

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _many(self, words: list[str], first: bool, together: int = 2000) -> list[bytes]:
        """Ids of words that follow a space (or begin a line), many in one call, told apart by their first ids."""
        out: list[bytes] = []
        parts = [words[i : i + together] for i in range(0, len(words), together)]
        joined = ["\n".join(p) if first else " " + " ".join(p) for p in parts]
        for part, e in zip(parts, self.tok.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            raw, w = ids.tobytes(), self.width
            if first:  # a line break parts them and shows as one id
                cut = np.flatnonzero(ids == np.frombuffer(self.line, self.kind)[0])
                begin, end = np.r_[0, cut + 1], np.r_[cut, len(ids)]
            else:
                begin = np.flatnonzero(self.opens[ids])
                end = np.r_[begin[1:], len(ids)]
            if len(begin) == len(part) and len(self.line) == w:
                out.extend(raw[a:b] for a, b in zip((begin * w).tolist(), (end * w).tolist()))
            else:
                out.extend(self.whole(x if first else " " + x) for x in part)
        return out

    def words(self, words: list[str], again: list[bool]) -> list[bytes]:
        """Ids of distinct words as they stand in texts; those met again are remembered while there is room."""
        out = [self.fixed.get(x) if len(x) < 2 else self.known.get(x) for x in words]
        new = [(i, words[i]) for i, x in enumerate(out) if x is None]
        stems: dict[str, bytes] = {}
        cut = []
        for _, x in new:
            n = len(x.rstrip(punctuation))
            n = n if 0 < n < len(x) and x[n - 1].isalnum() else len(x)  # closing signs are a pre-token of their own
            cut.append(n)
            stems[x[:n]] = b""
            if n < len(x):
                stems[_FIRST + x[n:]] = b""
        for first in (False, True):
            some = [x for x in stems if x.startswith(_FIRST) == first]
            stems.update(zip(some, self._many([x[1:] for x in some] if first else some, first)))
        for (i, x), n in zip(new, cut):
            out[i] = stems[x] if n == len(x) else stems[x[:n]] + stems[_FIRST + x[n:]]
            if again[i] and len(self.known) < COMMON_WORDS:
                self.known[x] = out[i]
        return out

    def encode(self, texts: pa.Array, end: int) -> list[bytes]:
        """Packed ids of each text, the end id last."""
        texts, stop = pc.fill_null(texts, ""), self.pack([end])
        tight = pc.match_substring_regex(texts, _TIGHT)
        some = pc.filter(texts, pc.invert(tight))
        lines = pc.replace_substring(some, "\n", " \n " + _FIRST)
        split = pc.split_pattern(pc.binary_join_element_wise(_FIRST, lines, ""), " ")
        coded = pc.dictionary_encode(split.flatten())
        at = coded.indices.to_numpy()
        again = np.bincount(at, minlength=len(coded.dictionary)) > 1
        ids = self.words(coded.dictionary.to_pylist(), again.tolist())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.width
        flat = np.frombuffer(b"".join(ids), self.kind)
        length, begin = size[at], (np.cumsum(size, dtype=np.int32) - size)[at]
        stops = np.cumsum(length, dtype=np.int32)
        gathered = flat[np.repeat(begin - stops + length, length) + np.arange(int(length.sum()), dtype=np.int32)].tobytes()
        edges = (np.r_[0, stops][split.offsets.to_numpy() - split.offsets[0].as_py()] * self.width).tolist()
        plain = (gathered[a:b] for a, b in zip(edges[:-1], edges[1:]))
        return [(self.whole(texts[i].as_py()) if t else next(plain)) + stop for i, t in enumerate(tight.to_pylist())]


_ENCODED = pa.schema([("part", pa.int32()), ("k", pa.int64()), ("head", pa.string()), ("mark", pa.int64()), ("salt", pa.int64()), ("ids", pa.binary())])
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _rank(k: int | None, head: str | None, mark: int, salt: int) -> tuple:
    """A row's place: keyless ones first, then by key, begin of the text and its hash; the salt tells only like rows apart."""
    return k is not None, k or 0, head or "", mark, salt


@released
def _encode(batches: Iterator[pa.RecordBatch], tokenizer_file: str, end: int, width: int, edges: list[tuple]) -> Iterator[pa.RecordBatch]:
    enc = _ENCODERS.get((tokenizer_file, width)) or _ENCODERS.setdefault((tokenizer_file, width), Encoder(tokenizer_file, width))
    for batch in batches:
        for rows in text_slices(batch, 4, SLICE_BYTES):
            part = [bisect_right(edges, _rank(*r)) for r in zip(*(c.to_pylist() for c in rows.columns[:4]))]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *rows.columns[:4], pa.array(enc.encode(rows.column(4), end), pa.binary())], schema=_ENCODED)


def _pack(name: int, base: int, keys: list[int | None], parts: list[bytes], width: int) -> pa.RecordBatch:
    n = np.array([len(p) // width for p in parts], np.int64)
    start = np.cumsum(n) - n
    k = np.array([NO_KEY if x is None else x for x in keys], np.int64)
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    total = np.add.reduceat(n, head)
    mph = PerfectHash.build(k[head])
    slot = mph.slots(k[head])
    offsets, lengths, prints = np.empty(len(head), "<u8"), np.empty(len(head), "<u8"), np.empty(len(head), "<u4")
    offsets[slot], lengths[slot], prints[slot] = start[head], total, fingerprint(k[head])
    raw = {"levels": mph.to_bytes(), "fingerprints": prints.tobytes(), "offsets": offsets.tobytes(), "lengths": lengths.tobytes(), "doc_starts": start.astype("<u8").tobytes(), "keys": k.astype("<i8").tobytes(), "ids": b"".join(parts)}
    numbers = {"shard": name, "base": base, "first_key": int(k[0]), "last_key": int(k[-1]), "width": width, "n_ids": int(n.sum()), "n_docs": len(n), "n_keyless": sum(x is None for x in keys)}
    return table({c: [v] for c, v in (numbers | raw).items()}, _SHARD)


@released
def _shards(batches: Iterator[pa.RecordBatch], width: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    part, number, base = TaskContext.get().partitionId(), 0, 0
    keys: list = []
    parts: list[bytes] = []
    size = 0
    for batch in batches:
        for k, p in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))):
            if size >= shard_ids:
                yield _pack((part << 32) + number, base, keys, parts, width)
                keys, parts, size, number, base = [], [], 0, number + 1, base + size
            keys.append(k)
            parts.append(p)
            size += len(p) // width
    if keys:
        yield _pack((part << 32) + number, base, keys, parts, width)


def write_store(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2, vocabulary: int = 50_257, shard_ids: int = SHARD_IDS) -> None:
    """Encode all documents and write their shards, in ascending key order, as the table ``path``.

    Texts are encoded in the tasks that read them, and the ids are dealt out by key ranges. Ranges are cut by a sample
    of places (about ``SAMPLED`` a range; it decides on nothing but the balance), which reaches the driver.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text, order = F.col(text_col).cast("string"), ("k", "head", "mark", "salt")
    base = docs.select(F.col(id_col).cast("long").alias("k"), F.substring(text, 1, HEAD).alias("head"), F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("salt"), text.alias("text"))
    share = SAMPLED * n / max(1, docs.count())
    places = sorted(_rank(*r) for r in base.select(*order).where(F.pmod(F.xxhash64("salt"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).collect())
    edges = [places[len(places) * i // n] for i in range(1, n)] if len(places) >= n else []
    coded = base.mapInArrow(partial(_encode, tokenizer_file=tokenizer_file, end=end, width=width, edges=edges), "part int, k long, head string, mark long, salt long, ids binary")
    ordered = coded.repartitionById(n, "part").sortWithinPartitions(*order).select("k", "ids")
    shards = ordered.mapInArrow(partial(_shards, width=width, shard_ids=shard_ids), LAYOUT)
    # One shard a row group, so that a filter on ``shard`` reads the shards asked for and no other.
    shards.write.option("compression", "zstd").option("parquet.block.row.count.limit", 1).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).parquet(path)


class Shard:
    """One record, opened for keyed access."""

    def __init__(self, levels: bytes, fingerprints: bytes, offsets: bytes, lengths: bytes, ids: bytes, width: int):
        self.mph = PerfectHash.from_bytes(levels)
        self.prints, self.offsets, self.lengths = np.frombuffer(fingerprints, "<u4"), np.frombuffer(offsets, "<u8"), np.frombuffer(lengths, "<u8")
        self.ids = np.frombuffer(ids, {2: "<u2", 4: "<u4"}[width])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, length) of each key, (-1, 0) where the fingerprint says it isn't here."""
        slot = self.mph.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok])
        at, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        at[ok], n[ok] = self.offsets[slot[ok]], self.lengths[slot[ok]]
        return at, n


_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_INDEX = ("shard", "levels", "fingerprints", "offsets", "lengths", "ids", "width")
_READ = (*_INDEX, "keys", "doc_starts", "n_ids", "n_keyless", "base")


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[Shard, dict]]:
    for batch in batches:
        for row in range(batch.num_rows):
            r = {c: batch.column(i)[row].as_py() for i, c in enumerate(columns)}
            yield Shard(*(r[c] for c in _INDEX[1:])), r


@released
def _digests(batches: Iterator[pa.RecordBatch], bases: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for shard, r in _rows(batches, _READ):
        keys, starts = np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["doc_starts"], "<u8").astype(np.int64)
        at, n = shard.find(keys)
        if (at < 0).any():
            raise ValueError(f"shard {r['shard']}: a stored key isn't found by its index")
        inside = starts - at  # documents of one key follow each other
        stop = np.minimum(np.r_[starts[1:], r["n_ids"]], at + n)
        begin = at + inside
        crc = [zlib.crc32(shard.ids[i:j].astype("<u4").tobytes()) for i, j in zip(begin.tolist(), stop.tolist())]
        names = pa.array(keys, pa.int64(), mask=np.arange(len(keys)) < r["n_keyless"])
        yield table({"doc_id": names, "start": begin + bases[r["shard"] >> 32] + r["base"], "n_tokens": stop - begin, "ids_crc32": crc}, _DIGEST)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, each found through its shard's index."""
    store = read_store(spark, path)
    bases, total = {}, 0
    sizes = store.groupBy(F.shiftright("shard", 32).alias("part")).agg(F.max(F.col("base") + F.col("n_ids")).alias("n"))
    for r in sizes.orderBy("part").collect():  # a number for each writing task, whose count is a setting
        bases[r["part"]], total = total, total + r["n"]
    return store.select(*_READ).mapInArrow(partial(_digests, bases=bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _route(batches: Iterator[pa.RecordBatch], names: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, shard) for each shard whose key range holds the key."""
    for batch in batches:
        k = batch.column(0).to_numpy()
        lo, hi = np.searchsorted(last, k, side="left"), np.searchsorted(first, k, side="right")
        n = np.maximum(hi - lo, 0)
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, n)), pa.array(names[at])], names=["k", "shard"])


#: Ranges of shards in one scan's filter, and scans of a lookup; what is asked beyond both is joined to its nearest.
RANGES, SCANS = 64, 32


def _ranges(places: np.ndarray, most: int = RANGES * SCANS) -> list[tuple[int, int]]:
    """Sorted places as at most so many closed ranges, the nearest ones joined."""
    gaps = np.diff(places)
    cut = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
    cut = cut[gaps[cut] > 1]
    return list(zip(places[np.r_[0, cut + 1]].tolist(), places[np.r_[cut, len(places) - 1]].tolist()))


def shards_at(store: DataFrame, names: np.ndarray, places: np.ndarray) -> DataFrame:
    """The stored shards at sorted places of the directory, by scans whose filters leave out the row groups of others."""
    parts = _blocks(iter(_ranges(places)), RANGES)
    scans = [reduce(Column.__or__, (F.col("shard").between(int(names[a]), int(names[b])) for a, b in part)) for part in parts]
    return reduce(DataFrame.union, (store.where(scan).select(*_INDEX) for scan in scans))


_FOUND = pa.schema([("k", pa.int64()), ("shard", pa.int64()), ("ids", pa.list_(pa.int32()))])


@released
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, r in _rows(batches, (*_INDEX, "wanted")):
        keys = np.array(r["wanted"], np.int64)
        at, n = shard.find(keys)
        hit = np.flatnonzero(at >= 0)
        yield table({"k": keys[hit], "shard": [r["shard"]] * len(hit), "ids": [shard.ids[at[i] : at[i] + n[i]] for i in hit]}, _FOUND)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "key", block: int = BROADCAST_ROWS) -> DataFrame:
    """key, ids for each row of ``keys`` (ids null where absent); a null key asks for keyless documents.

    Keys are routed by the directory of shards (two keys each), which goes to the tasks in blocks of at most ``block``
    shards. Up to ``RANGES`` times ``SCANS`` shards that don't follow each other are read alone, by their row groups;
    of more, the nearest ones are read with those between them. A key costs a constant number of probes in each.
    Ids of documents that share a key follow each other. Where more than ``block`` distinct keys are asked for,
    shards travel to them by a shuffle, else the keys are sent to the shards.
    """
    store = read_store(spark, path)
    asked = keys.select(F.col(key_col).cast("long").alias("key"), F.coalesce(F.col(key_col).cast("long"), F.lit(NO_KEY)).alias("k"))
    found = spark.createDataFrame([], "k long, shard long, ids array<int>")
    for part in _blocks(store.select("shard", "first_key", "last_key").orderBy("shard").toLocalIterator(), block):
        names, first, last = np.array(part, np.int64).T
        routed = materialize(asked.select("k").distinct().mapInArrow(partial(_route, names=names, first=first, last=last), "k long, shard long"), "routed")
        places = np.searchsorted(names, np.array([r["shard"] for r in routed.select("shard").distinct().collect()], np.int64))  # at most a block
        if not len(places):
            continue
        wanted = routed.groupBy("shard").agg(F.collect_list("k").alias("wanted"))
        wanted = F.broadcast(wanted) if routed.count() <= block else wanted
        found = found.union(shards_at(store, names, np.sort(places)).join(wanted, "shard").select(*_INDEX, "wanted").mapInArrow(_find, "k long, shard long, ids array<int>"))
    whole = found.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "ids"))), lambda x: x["ids"]).alias("ids"))
    return asked.join(whole, "k", "left").select("key", F.flatten("ids").alias("ids"))


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield part


def store_documents(docs: DataFrame, tokenizer_file: str, path: str | None = None, **kw) -> DataFrame:
    """Write the store (to a fresh scratch path unless one is given) and return its ``document_digests``."""
    path = path or scratch_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer_file, **kw)
    return document_digests(docs.sparkSession, path)
