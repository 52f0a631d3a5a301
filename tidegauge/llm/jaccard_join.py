"""N-gram Jaccard join by parity sketches.

A document's tokens (hashed five-word shingles) toggle bits of a sparse bit sketch: token t of a document in
size band s belongs to one of K = s + 16 parts and toggles one of 2**32 bits there. Two sketches differ in at
most |A xor B| bits, and a Jaccard similarity of 0.8 allows at most (|A| + |B|) / 9 differing tokens, so at least
(non-empty parts of A) - d parts are equal and non-empty in both. By the pigeonhole (prefix) argument over any
common order of parts, the first d + 1 non-empty parts of both documents then share one. Parts are ordered
rarest first by a fixed-size count sketch of all tokens, so common passages don't make candidates. Candidates
are verified on whole token sets. Documents whose parts are too few for the argument ("weak") also emit a
classic token prefix, which finds every pair of two weak documents.

Exact copies share a set fingerprint and are one vertex from the start. Keys shared by many documents give a
star to their cleanest member first. After components are known, only keys that still join two components are
compared in full, one key for each set of members, by sizes and sketches: a pair that shares many keys at one of
its smallest, a crowded key by pairs of blocks of its members, and each member gives its nearest few candidates a
round; a further round takes the keys that held some back, until none does. So no link is lost, and a round's candidates are linear in the members.

Null text, or text without words: empty set, n_shingles 0, linked with nothing, component_id is its own doc_id.
Null doc_id: the row takes part and its own id counts for nothing in a component's smallest id. Repeated rows
give repeated result rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidegauge.llm.common import BROADCAST_ROWS, discard, hash_parts, materialize, mix64, released, table, word_hashes
from tidegauge.llm.components import connected_components

SHINGLE = 5
#: 2**SKETCH_BITS counters of token frequency, whatever the corpus size.
SKETCH_BITS, SKETCH_RANGES = 20, 16
#: A key of at most so many documents gives all its pairs at once; a larger one first gives its star.
SMALL_GROUP = 2
#: Members of an open key that one task compares; a larger key is dealt out by pairs of blocks of so many.
CROWD = 512
#: Smallest open keys that a member carries, so that a pair of many keys is compared at one of them.
CARRIED = 4
#: Candidates that a member of an open key gives in the first round; four times as many in each further one.
NEAREST = 128
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text (A-Z lowered, words between ASCII white space)."""
    w = word_hashes((text or b"").lower())[0]
    if not len(w):
        return w
    m = len(w) - k + 1
    if m < 1:  # the whole sequence is one shingle, told apart by its length
        total = np.uint64(len(w))
        with np.errstate(over="ignore"):
            total += (w * _ODD[: len(w)]).sum(dtype=np.uint64)
        return mix64(np.array([total], np.uint64))
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h += w[j : j + m] * (_ODD[j % len(_ODD)] + np.uint64(2 * (j // len(_ODD))))
    return np.unique(mix64(h))


def set_class(u: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a token set."""
    total = int(mix64(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + len(u) * int(_ODD[0])
    return int(np.array(total & (2**64 - 1), np.uint64).astype(np.int64)) if len(u) else 0


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])


@released
def _survey(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, set size, fingerprint) of each document, and the task's token counters by range."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    shift = np.uint64(64 - SKETCH_BITS)
    for batch in sliced(batches, 2000):
        sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
        if any(len(s) for s in sets):
            counts += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=1 << SKETCH_BITS)
        n = len(sets)
        yield table({"id": batch.column(0), "n": [len(s) for s in sets], "cls": [set_class(s) if len(s) else None for s in sets], "part": [None] * n, "counts": [None] * n}, _SETS)
    for r, c in enumerate(np.split(counts, SKETCH_RANGES)):
        if c.any():
            yield table({"id": [None], "n": [None], "cls": [None], "part": [r], "counts": [c.astype("<i8").tobytes()]}, _SETS)


_SUMS = pa.schema([("part", pa.int32()), ("counts", pa.binary())])


def _sum_counts(t: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_RANGES, np.int64)
    for c in t.column("counts").to_pylist():
        total += np.frombuffer(c, "<i8")
    levels = np.floor(4 * np.log2(total + 1)).astype(np.uint8)
    return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "counts": pa.array([levels.tobytes()], pa.binary())})


def band_keys(u: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys of a token set in its size bands, and how rare its tokens are on the whole (a group's cleanest copy has the least)."""
    n, out = len(u), []
    d = n // 4
    level = levels[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    band = n.bit_length() - 1
    bit = mix64((u & np.uint64(0xFFFFFFFF)) + np.uint64(1))
    for b in [band] + [band + 1] * (5 * n >= 4 << (band + 1)):
        part = ((u >> np.uint64(20)) % np.uint64((1 << b) + 16)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        p = part[order]
        at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        sig = np.bitwise_xor.reduceat(bit[order], at)
        rare = np.minimum.reduceat(level[order], at)
        full = sig != 0
        sig = mix64(sig[full] + (p[at][full].astype(np.uint64) << np.uint64(8)) * _ODD[1] + np.uint64(b * int(_ODD[2]) & (2**64 - 1)))
        if len(sig) > d + 1:
            sig = sig[np.lexsort((sig, rare[full]))[: d + 1]]
        elif len(sig) <= d:  # weak: every token of the prefix is a key too
            out.append(mix64(u[: n - (4 * n + 4) // 5 + 1] ^ _ODD[3]))
        out.append(sig)
    return np.unique(np.concatenate(out)), 255 - int(level.mean())


_KEYS = pa.schema([("p", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("junk", pa.binary())])


@released
def _emit(batches: Iterator[pa.RecordBatch], k: int, levels: bytes, parts: int) -> Iterator[pa.RecordBatch]:
    """Keys of the documents, packed by hash range; exact copies in one task emit once."""
    lv, seen = np.frombuffer(levels, np.uint8), set()
    held: list[tuple[np.ndarray, int, int]] = []
    n_held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([h[0] for h in held])
        lens = [len(h[0]) for h in held]
        docs = np.repeat(np.array([h[1] for h in held], "<i8"), lens)
        junk = np.repeat(np.array([min(h[2], 255) for h in held], np.uint8), lens)
        p = (keys >> np.uint64(40)).astype(np.int64) % parts
        order = np.argsort(p, kind="stable")
        p = p[order]
        low = keys[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        at = np.r_[np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), len(p)]
        for i, j in zip(at[:-1], at[1:]):
            o = order[i:j]
            yield table({"p": [int(p[i])], "keys": [low[i:j].tobytes()], "docs": [docs[o].tobytes()], "junk": [junk[o].tobytes()]}, _KEYS)

    for batch in sliced(batches, 1000):
        for text in batch.column(0).to_pylist():
            u = shingle_set(text, k)
            if not len(u) or (c := set_class(u)) in seen:
                continue
            seen.add(c)
            keys, junk = band_keys(u, lv)
            held.append((keys, c, junk))
            n_held += len(keys)
            if n_held > 2_000_000:
                yield from flush()
                held, n_held = [], 0
    if held:
        yield from flush()


_PAIRS = pa.schema([("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _candidates(t: pa.Table, small_group: int) -> pa.Table:
    """Pairs (k null) of documents that share a key, and the members (k, a) of keys too common to give all pairs."""
    raw = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 5) for x in t.column("keys").to_pylist()])
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :5] = raw
    keys = keys.view("<u8")[:, 0]
    docs = np.concatenate([np.frombuffer(x, "<i8") for x in t.column("docs").to_pylist()])
    junk = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("junk").to_pylist()])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.r_[True, k[1:] != k[:-1]]
    size = np.diff(np.r_[np.flatnonzero(start), len(k)])
    size = np.repeat(size, size)
    order, size = order[size > 1], size[size > 1]
    if not len(order):
        return _PAIRS.empty_table()
    order = order[np.lexsort((docs[order], junk[order], keys[order]))]  # each key's cleanest member first
    k, d = keys[order], docs[order]
    once = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]  # a set that several tasks sent is one member
    k, d = k[once], d[once]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[start, len(k)])
    first = np.repeat(d[start], size)
    size = np.repeat(size, size)
    small = size <= small_group
    a, b = [first[~small]], [d[~small]]
    for off in range(1, small_group):
        i = np.flatnonzero((k[off:] == k[:-off]) & small[off:]) if len(k) > off else []
        if not len(i):
            break
        a.append(d[i])
        b.append(d[i + off])
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
    big = ~small
    kk = (k[big].astype(np.int64) << 20) | int(t.column("p")[0].as_py() & 0xFFFFF)
    return pa.table({"k": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(kk, pa.int64())]), "a": pa.array(np.r_[pairs[:, 0], d[big]], pa.int64()), "b": pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(int(big.sum()), pa.int64())])}, schema=_PAIRS)


_TOKENS = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("toks", pa.binary())])


@released
def _token_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 500):
        sets = [shingle_set(x, k) for x in batch.column(0).to_pylist()]
        yield table({"cls": [set_class(s) for s in sets], "n": [len(s) for s in sets], "sketch": [dense_sketch(s).tobytes() for s in sets], "toks": [s.astype("<u8").tobytes() for s in sets]}, _TOKENS)


def dense_sketch(u: np.ndarray) -> np.ndarray:
    """Parity of the tokens on each of 512 bits or more (about as many as tokens), as 64-bit words."""
    bits = max(512, 1 << (len(u).bit_length() - 1) if len(u) else 0)
    parity = np.bincount((u % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view("<u8")


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bits: halves add up, bit by bit."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@released
def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
        keep = []
        for i, (s, t) in enumerate(zip(x, y)):
            if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                continue
            both = len(np.intersect1d(np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8"), assume_unique=True))
            if 100 * both >= percent * ((len(s) + len(t)) // 8 - both):
                keep.append(i)
        yield table({"a": [a[i] for i in keep], "b": [b[i] for i in keep]}, _EDGES)


@released
def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches allow the similarity: sketches differ in no more bits than sets in tokens."""
    for batch in batches:
        a, b, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
        keep = []
        for i in range(len(a)):
            if 100 * min(n[i], m[i]) >= percent * max(n[i], m[i]):
                s, t = np.frombuffer(x[i], "<u8"), np.frombuffer(y[i], "<u8")
                words = min(len(s), len(t))
                if int(np.bitwise_count(fold(s, words) ^ fold(t, words)).sum()) * (100 + percent) <= (100 - percent) * (n[i] + m[i]):
                    keep.append(i)
        yield table({"a": [a[i] for i in keep], "b": [b[i] for i in keep]}, _EDGES)


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about so many rows that end where a group ends; rows of one (k, i, j) follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held)
            if len(edges := np.flatnonzero(_group_starts(t))) > 1:
                yield t.slice(0, edges[-1]).combine_chunks()
                t = t.slice(edges[-1])
            held = t.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _group_starts(t: pa.Table) -> np.ndarray:
    k = np.stack([t.column(c).to_numpy() for c in ("k", "i", "j")])
    return np.r_[True, (k[:, 1:] != k[:, :-1]).any(0)]


class _Sketches:
    """Sketches of several widths, compared by pairs of rows whose widths differ by one doubling at most."""

    def __init__(self, raw: list[bytes]):
        self.words = np.array([len(x) // 8 for x in raw], np.int64)
        self.place, self.of = np.empty(len(raw), np.int64), {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.place[at] = np.arange(len(at))
            self.of[w] = np.frombuffer(b"".join(raw[x] for x in at), "<u8").reshape(-1, w)

    def _at(self, rows: np.ndarray, words: int) -> np.ndarray:
        out, own = np.empty((len(rows), words), np.uint64), self.words[rows] == words
        out[own] = self.of[words][self.place[rows[own]]] if own.any() else 0
        if not own.all():
            wide = self.of[2 * words][self.place[rows[~own]]]
            out[~own] = wide[:, :words] ^ wide[:, words:]
        return out

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of rows a and rows b differ."""
        out, words = np.empty(len(a), np.int64), np.minimum(self.words[a], self.words[b])
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            for part in np.array_split(at, 1 + len(at) * w // 1_000_000):
                out[part] = np.bitwise_count(self._at(a[part], w) ^ self._at(b[part], w)).sum(1)
        return out


@released
def _open_pairs(batches: Iterator[pa.RecordBatch], percent: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a group's members in different components whose sizes and sketches allow the similarity.

    A pair is left to another key if both members carry a smaller one in common. A member gives at most ``most``
    pairs, the nearest ones; where it has more, a row (key, no b) tells that the key still holds some back.
    """
    for t in _whole_groups(batches):
        k, i, j, own, cls, comp, n = (t.column(c).to_numpy() for c in ("k", "i", "j", "own", "cls", "comp", "n"))
        group = np.cumsum(_group_starts(t))
        low = np.full((len(k), CARRIED), np.iinfo(np.int64).max)
        lists = t.column("low").chunk(0)
        lens = lists.value_lengths().to_numpy()
        low[np.arange(CARRIED) < lens[:, None]] = lists.flatten().to_numpy()
        sketches = _Sketches(t.column("sketch").to_pylist())
        tested = {(c, x) for c, xs in zip(cls.tolist(), t.column("tested").to_pylist()) for x in xs or ()}
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        p, off = np.arange(len(k)), 1
        while len(p := p[p + off < len(k)]) and len(p := p[group[p + off] == group[p]]):
            q = p + off
            ok = (comp[p] != comp[q]) & ((i[p] == j[p]) | (own[p] != own[q])) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
            a, b, off = p[ok], q[ok], off + 1
            if len(a):
                elsewhere = ((low[a][:, :, None] == low[b][:, None, :]) & (low[a] < k[a][:, None])[:, :, None]).any((1, 2))
                a, b = a[~elsewhere], b[~elsewhere]
                d = sketches.far(a, b)
                ok = d * (100 + percent) <= (100 - percent) * (n[a] + n[b])
                found.append((a[ok], b[ok], d[ok]))
        if not found:
            continue
        a, b, d = (np.concatenate(x) for x in zip(*found))
        if tested:
            new = np.array([(x, y) not in tested for x, y in zip(cls[a].tolist(), cls[b].tolist())], bool)
            a, b, d = a[new], b[new], d[new]
        order = np.lexsort((d, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        more = np.unique(k[a[rank >= most]])
        a, b = cls[a[rank < most]], cls[b[rank < most]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield table({"a": np.r_[pairs[:, 0], more], "b": pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(more), pa.int64())])}, _EDGES)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 80, **kw) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and copies (rows of the same set), a row per document.

    ``percent`` is the least similarity in hundredths; key prefixes are laid out for 80 or more.
    """
    rows, whole = _components(docs, id_col, text_col, shingle, percent, **kw)
    return rows.join(whole, "cls", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def _components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 80, broadcast_rows: int = BROADCAST_ROWS, small_group: int = SMALL_GROUP, crowded: int = CROWD, nearest: int = NEAREST) -> tuple[DataFrame, DataFrame]:
    """(id, n, cls) of each document, cls null without words, and (cls, comp, component_id, copies) of each set: comp tells components of one smallest id apart."""
    if percent < 80:
        raise ValueError("the sketch layout holds for similarities of 0.8 or more")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    survey = materialize(base.mapInArrow(partial(_survey, k=shingle), "id long, n long, cls long, part int, counts binary"), "sets")
    rows = survey.where("part is null").select("id", "n", "cls")
    sums = survey.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_sum_counts, "part int, counts binary").collect()
    width = (1 << SKETCH_BITS) // SKETCH_RANGES
    by = {r["part"]: bytes(r["counts"]) for r in sums}  # 2**SKETCH_BITS bytes in all
    levels = b"".join(by.get(r, bytes(width)) for r in range(SKETCH_RANGES))

    packed = base.select("text").mapInArrow(partial(_emit, k=shingle, levels=levels, parts=hash_parts(spark)), "p int, keys binary, docs binary, junk binary")
    found = materialize(packed.groupBy("p").applyInArrow(lambda t: _candidates(t, small_group), "k long, a long, b long"), "candidates")
    pairs = materialize(found.where("k is null").select("a", "b").distinct(), "pairs")
    crowd = found.where("k is not null").select("k", F.col("a").alias("cls"))

    # Whole token sets of the documents in any pair: one document stands for each set.
    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    stand_in = rows.where("cls is not null").groupBy("cls").agg(F.min(F.coalesce("id", F.lit(-(2**63)))).alias("id"))
    wanted = materialize(stand_in.join(ids, "cls", "left_semi").select("id").distinct(), "wanted")
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    keyed = base.withColumn("id", F.coalesce("id", F.lit(-(2**63))))
    sets = materialize(keyed.join(wanted, "id", "left_semi").select("text").mapInArrow(partial(_token_sets, k=shingle), "cls long, n long, sketch binary, toks binary"), "tokens")

    if sets.count() > sets.select("cls").distinct().count():  # null or repeated ids
        once = materialize(sets.join(ids, "cls", "left_semi").dropDuplicates(["cls"]), "tokens")
        discard(sets)
        sets = once
    light = sets.select("cls", "n", "sketch")

    def near(pairs: DataFrame) -> DataFrame:
        left = pairs.join(light.select(F.col("cls").alias("a"), "n", F.col("sketch").alias("x")), "a")
        both = left.join(light.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
        return both.select("a", "b", "n", "m", "x", "y").mapInArrow(partial(_near, percent=percent), "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = materialize(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "ends")
        few = sets.select("cls", "toks").join(F.broadcast(ends) if ends.count() <= broadcast_rows else ends, "cls", "left_semi")
        left = pairs.join(few.select(F.col("cls").alias("a"), F.col("toks").alias("x")), "a")
        both = left.join(few.select(F.col("cls").alias("b"), F.col("toks").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(partial(_verify, percent=percent), "a long, b long")

    near_pairs = materialize(near(pairs), "near")
    edges = materialize(verified(near_pairs), "edges")
    labels = connected_components(edges)
    tested, most = near_pairs.where("false"), nearest
    while not crowd.isEmpty():
        members = crowd.join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        several = members.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cls")).alias("set")).where("lo <> hi")
        # A passage gives many keys of the same members: one of them stands for all.
        several = several.groupBy("lo", "hi", "size", "set").agg(F.min("k").alias("k")).select("k", F.ceil(F.col("size") / crowded).alias("blocks"))
        now_open = materialize(members.join(several, "k"), "open")
        if now_open.isEmpty():
            break
        out = materialize(_compare_open(now_open, light, tested, percent, most), "open-pairs")
        fresh = materialize(out.where("b is not null").distinct().join(pairs, ["a", "b"], "left_anti"), "fresh")
        labels = connected_components(labels.select(F.col("v").alias("a"), F.col("comp").alias("b")).union(verified(fresh)))
        held = out.where("b is null").select(F.col("a").alias("k")).distinct()
        if held.isEmpty():
            break
        crowd = materialize(crowd.join(held, "k", "left_semi"), "held")  # the other keys have given all their pairs
        tested, most = materialize(tested.union(fresh).union(pairs), "tested"), 4 * most
    # Copies collapse before the join, so a hot group is one row of each side.
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    named = materialize(classes.join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "classes")
    smallest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    whole = materialize(named.join(smallest, "comp").select("cls", "comp", "component_id", "copies"), "components")
    discard(found, pairs, wanted, sets, near_pairs, edges, named)
    return rows, whole


def _compare_open(now_open: DataFrame, light: DataFrame, tested: DataFrame, percent: int, most: int) -> DataFrame:
    """``_open_pairs`` of the members (k, cls, comp, blocks) of open keys; a key of several blocks meets block by block."""
    low = now_open.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list("k")), 1, CARRIED).alias("low"))
    both = tested.union(tested.select("b", "a")).groupBy(F.col("a").alias("cls")).agg(F.collect_list("b").alias("tested"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("own")
    dealt = now_open.select("k", "cls", "comp", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "comp")
    about = light.join(low, "cls").join(both, "cls", "left")
    placed = rows.join(about, "cls").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return placed.select("k", "i", "j", "own", "cls", "comp", "n", "low", "sketch", "tested").mapInArrow(partial(_open_pairs, percent=percent, most=most), "a long, b long")


_CLASS = "__cls"


@released
def _classes(batches: Iterator[pa.RecordBatch], text_at: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each row with the fingerprint of its token set, null without words."""
    for batch in sliced(batches, 2000):
        sets = [shingle_set(t, k) for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
        yield batch.append_column(_CLASS, pa.array([set_class(u) if len(u) else None for u in sets], pa.int64()))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, that of the smallest id (null ids come last).

    Rows without words stay. Where ids are null or repeated, the id doesn't tell rows apart: there a row goes by its
    id and token set, so a different text under the same id is a row of its own. Among the rows of a component's
    smallest id the least set fingerprint stays, and of equal sets the least text.
    """
    limit = kw.get("broadcast_rows", BROADCAST_ROWS)
    rows, whole = _components(docs, id_col, text_col, **kw)
    found = materialize(rows.join(whole, "cls", "left").select("id", "cls", "comp", "component_id"), "links")
    drop = materialize(found.where("id <> component_id").select(F.col("id").alias("__id")).distinct(), "drop")
    twice = materialize(found.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("__id")), "twice")

    def by_id(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(ids) if ids.count() <= limit else ids, rows[id_col].cast("long") == ids["__id"], how)

    if twice.isEmpty() and found.where("id is null").isEmpty():
        return by_id(docs, drop, "left_anti")
    known = docs.where(F.col(id_col).isNotNull())
    unclear = docs.where(F.col(id_col).isNull()).unionByName(by_id(known, twice, "left_semi"))
    schema = StructType([*docs.schema.fields, StructField(_CLASS, LongType())])
    unclear = materialize(unclear.mapInArrow(partial(_classes, text_at=docs.columns.index(text_col), k=kw.get("shingle", SHINGLE)), schema), "unclear")
    first = found.where("cls is not null").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("cls").alias("cls"))).alias("f"))
    first = first.select(F.col("f.id").alias("__id"), F.col("f.cls").alias("__first"))
    best = unclear.where(F.col(_CLASS).isNotNull()).join(first, (F.col(_CLASS) == F.col("__first")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left_semi")
    best = best.groupBy(F.col(id_col).alias("__id"), _CLASS).agg(F.min_by(F.struct(*docs.columns), text_col).alias("row")).select("row.*")
    return by_id(by_id(known, twice, "left_anti"), drop, "left_anti").unionByName(unclear.where(F.col(_CLASS).isNull()).select(*docs.columns)).unionByName(best)
