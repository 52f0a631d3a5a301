"""Benchmark decontamination with an FM-index per training shard.

Benchmark items give phrases: every window of ten consecutive words, or the whole item if it has fewer. A shard is a
run of documents held by one task. All its words become ids of the shard's own vocabulary, and over its distinct texts,
parted by unique separators, a suffix array, its Burrows-Wheeler transform in a wavelet matrix and sampled suffix
positions are built, with no regard to the benchmark. Phrases are then searched backwards, all at once, through rank
queries; occurrences are located by walking to sampled positions, and hit words merge into removal spans.

The benchmark is read in blocks of bounded size, one at a time on the driver; a block is sent to all tasks, and
documents are scanned once a block. With several blocks, documents are written with a row number, by which the hits of
all blocks meet; results don't depend on the number of blocks. Null or empty document text has no words and no hits.
Null, empty or wordless items give no phrase. A null item_id counts as the text "null". Items that share an id count
once; repeated documents give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial, reduce
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import IdCache, discard, materialize, released, table, text_slices

WINDOW = 10
#: Characters of benchmark text that one block may hold.
BLOCK_CHARS = 8_000_000
#: Words (of about six bytes) that a shard holds before its index is built, and the spacing of sampled positions.
SHARD_WORDS, SAMPLE = 600_000, 8
#: Bytes that aren't word characters, as given by the contract: every ASCII byte but digits and letters.
_BREAKS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TO_SPACE = bytes.maketrans(_BREAKS + bytes(range(65, 91)), b" " * len(_BREAKS) + bytes(range(97, 123)))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII characters other than digits and letters, with A-Z lowered."""
    return (text or b"").translate(_TO_SPACE).split()


class WaveletMatrix:
    """Rank queries over an integer sequence: a bit vector a level, zeros before ones."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(values), bits, []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((ones, self.n - int(ones[-1])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i, less where its block begins."""
        at = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            at, i = np.where(one, zeros + ones[at], at - ones[at]), np.where(one, zeros + ones[i], i - ones[i])
        return i - at

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, at, start = np.zeros_like(i), i, np.zeros_like(i)
        for ones, zeros in self.levels:
            one = ones[at + 1] > ones[at]
            symbol = 2 * symbol + one
            at, start = np.where(one, zeros + ones[at], at - ones[at]), np.where(one, zeros + ones[start], start - ones[start])
        return symbol, at - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order: a first sort by as many symbols as a long holds, then by doubled prefixes those still alike.

    Symbols are at least 0 and the last one is unique, as is any symbol that parts runs.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for at in range(step):
        key <<= bits
        key[: max(0, n - at)] |= text[at:]
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[head, n])
    rank = np.empty(n, np.int64)  # where a suffix's group begins in the order
    rank[order] = np.repeat(head, size)
    place = np.flatnonzero(np.repeat(size, size) > 1)
    while len(place):
        alike = order[place]
        key = rank[alike] * (n + 1) + rank[alike + step]  # no suffix that is like another reaches the end here
        by = np.argsort(key)
        alike, key = alike[by], key[by]
        order[place] = alike
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[head, len(key)])
        rank[alike] = np.repeat(place[head], size)
        place = place[np.repeat(size, size) > 1]
        step *= 2
    return order


class FMIndex:
    """Over ids 1..vocabulary; zeros in ``text`` part the runs, and the last symbol must be one."""

    def __init__(self, text: np.ndarray, vocabulary: int):
        self.n = len(text)
        gaps = np.flatnonzero(text == 0)
        unique = text.astype(np.int64) + len(gaps)  # each separator is a symbol of its own, so no suffix compare passes it
        unique[gaps] = np.arange(len(gaps))
        sa = suffix_array(unique)
        bwt = text[sa - 1].astype(np.int64)
        self.gaps = len(gaps)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=vocabulary + 1))]
        self.tree = WaveletMatrix(bwt, max(1, int(vocabulary).bit_length()))
        self.sampled = (sa % SAMPLE == 0) | (bwt == 0)  # a run's first word is always sampled
        self.before = np.r_[0, np.cumsum(self.sampled)]
        self.positions = sa[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each phrase (rows of ``phrases``, padded with zeros), by backward search of all at once."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((j < lengths) & (lo < hi))
            s = phrases[on, j]
            lo[on], hi[on] = self.first[s] + self.tree.rank(s, lo[on]), self.first[s] + self.tree.rank(s, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows inside runs: step back until a sampled position or a run's start."""
        out, steps, live = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            r = rows[live]
            hit = self.sampled[r]
            out[live[hit]] = self.positions[self.before[r[hit]]] + steps[live[hit]]
            live = live[~hit]
            symbol, rank = self.tree.access(rows[live])
            rows[live] = self.first[symbol] + rank
            steps[live] += 1
        return out


class Items:
    """A block of items: their words as ids of the block's vocabulary, where each distinct window stands, and whose it is.

    A window is searched and located once, however many items have it. So a shard has at most one occurrence a word
    and window length, whatever the benchmark repeats.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        vocabulary = IdCache()
        words = [np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)) for w in (words_of(t) for _, t in items)]
        self.names = [name for name, _ in items]
        self.vocabulary = list(vocabulary)
        self.flat = np.concatenate([*words, np.empty(0, np.int32)])
        size = np.array([len(w) for w in words], np.int64)
        count = np.where(size, np.maximum(size - window + 1, 1), 0)
        owner = np.repeat(np.arange(len(items)), count)
        begin = np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        length = np.minimum(size, window)[owner]
        alike = np.zeros(len(begin), np.int64)  # number of a window's first words, then of all its words
        for j in range(int(length.max(initial=0))):
            word = np.where(j < length, self.flat[np.minimum(begin + j, len(self.flat) - 1)] + 1, 0)
            alike = np.unique(alike * (len(self.vocabulary) + 1) + word, return_inverse=True)[1]
        first = np.unique(alike, return_index=True)[1]
        self.begin, self.length = begin[first], length[first]
        self.owner = owner[np.argsort(alike, kind="stable")].astype(np.int32)
        self.owners = np.r_[0, np.cumsum(np.bincount(alike, minlength=len(first)))]

    def owners_of(self, windows: np.ndarray) -> list[str]:
        """Names of the items that have one of the windows, in order."""
        lo, count = self.owners[windows], self.owners[windows + 1] - self.owners[windows]
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return sorted({self.names[x] for x in np.unique(self.owner[at]).tolist()})

    def phrases(self, known: dict[bytes, int], rows: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, their words as ids of ``known``) for the windows that have no other word, some at a time."""
        ids = np.fromiter(map(known.get, self.vocabulary, repeat(0)), np.int64, len(self.vocabulary))[self.flat]
        strange = np.r_[0, np.cumsum(ids == 0)]
        here = np.flatnonzero(strange[self.begin + self.length] == strange[self.begin])
        ids = np.r_[ids, np.zeros(int(self.length.max()) if len(self.length) else 0, np.int64)]
        for at in range(0, len(here), rows):
            part = here[at : at + rows]
            span = np.arange(int(self.length[part].max()))
            yield part, np.where(span < self.length[part][:, None], ids[self.begin[part][:, None] + span], 0)


def hits(docs: list[np.ndarray], known: dict[bytes, int], items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, window) of every occurrence in documents given as ids of ``known``, from 1 on."""
    none = np.empty(0, np.int64)
    size = np.array([len(d) + 1 for d in docs], np.int64)  # with the separator
    if not len(docs) or not len(items.begin):
        return none, none, none
    text = np.zeros(int(size.sum()), np.int64)
    start = np.cumsum(size) - size
    inside = np.ones(len(text), bool)
    inside[start + size - 1] = False
    text[inside] = np.concatenate(docs)
    index = FMIndex(text, len(known))
    place, window = [none], [none]
    for which, rows in items.phrases(known):
        lo, hi = index.search(rows, items.length[which])
        count = hi - lo
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        place.append(index.locate(at))
        window.append(np.repeat(which, count))
    place, window = np.concatenate(place), np.concatenate(window)
    doc = np.searchsorted(start, place, side="right") - 1
    return doc, place - start[doc], window


_FOUND = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def merge_spans(begin: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of half-open spans, adjacent ones joined."""
    if not len(begin):
        return [], []
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return begin[new].tolist(), reach[np.r_[new[1:] - 1, len(begin) - 1]].tolist()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            ids.append(i.as_py())
            texts.append(t.as_py())
            size += len(texts[-1] or b"") // 6
            if size >= SHARD_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def shard_hits(texts: list[bytes | None], items: Items) -> tuple[list[int], list[tuple[list[int], list[int], np.ndarray]]]:
    """Word counts, and of each text its merged spans and the distinct windows found. Equal texts are indexed once."""
    numbers, distinct = IdCache(), IdCache()
    numbers[b""] = 0  # ids begin with 1
    which = [distinct[t or b""] for t in texts]
    docs = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in map(words_of, distinct)]
    doc, begin, window = hits(docs, numbers, items)
    out: list = [([], [], np.empty(0, np.int64))] * len(docs)
    order = np.argsort(doc, kind="stable")
    doc, begin, window = doc[order], begin[order], window[order]
    at = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)] if len(doc) else np.zeros(1, np.int64)
    for i, j in zip(at[:-1], at[1:]):
        b, e = merge_spans(begin[i:j], begin[i:j] + items.length[window[i:j]])
        out[int(doc[i])] = (b, e, np.unique(window[i:j]))
    return [len(docs[x]) for x in which], [out[x] for x in which]


@released
def _find(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for ids, texts in _shards(batches):
        n, found = shard_hits(texts, items)
        for rows in _portions(found, items):
            part = found[rows]
            yield table({"id": ids[rows], "n_words": n[rows], "begins": [f[0] for f in part], "ends": [f[1] for f in part], "items": [items.owners_of(f[2]) for f in part]}, _FOUND)


def _portions(found: list[tuple[list[int], list[int], np.ndarray]], items: Items, names: int = 500_000) -> Iterator[slice]:
    """Runs of rows with at most some number of item names (or one row), which are written out only then."""
    at = total = 0
    for i, (_, _, w) in enumerate(found):
        n = int((items.owners[w + 1] - items.owners[w]).sum())
        if i > at and total + n > names:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if found:
        yield slice(at, len(found))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int, window: int) -> Iterator[Items]:
    """The benchmark in blocks of at most ``block_chars`` characters (or one item), streamed to the driver."""
    block: list = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        t = None if r["t"] is None else bytes(r["t"])
        if block and size + len(t or b"") > block_chars:
            yield Items(block, window)
            block, size = [], 0
        block.append((r["i"], t))
        size += len(t or b"")
    if block:
        yield Items(block, window)


_KIND = "id long, n_words long, begins array<long>, ends array<long>, items array<string>"
#: Identity of a row while several blocks are searched; fixed by writing it.
_ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    return materialize(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")


def _block_hits(base: DataFrame, text_col: str, blocks: Iterable[Items]) -> DataFrame:
    """__row, b, e, i of the rows with hits: spans (not merged yet) and items of all blocks, each block's written out."""
    texts = base.select(_ROW, F.col(text_col).cast("binary"))
    found = [materialize(texts.mapInArrow(partial(_find, items=p), _KIND).where("size(begins) > 0"), "block") for p in blocks]
    some = reduce(DataFrame.union, found)
    out = materialize(some.groupBy(F.col("id").alias(_ROW)).agg(F.flatten(F.collect_list("begins")).alias("b"), F.flatten(F.collect_list("ends")).alias("e"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i")), "hits")
    discard(*found)
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, n_words, begins, ends (merged spans of hit words), items: a row per document."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_chars, window)
    one, two = next(blocks, Items([])), next(blocks, None)
    if two is None:
        return base.mapInArrow(partial(_find, items=one), _KIND)
    # Of further blocks only documents with hits come back; they meet by row, as ids may be null or repeated.
    base = _numbered(base)
    first = base.select(_ROW, "text").mapInArrow(partial(_find, items=one), _KIND).withColumnRenamed("id", _ROW)
    none = {c: F.array().cast(f"array<{t}>") for c, t in (("b", "long"), ("e", "long"), ("i", "string"))}
    joined = base.select(_ROW, "id").join(first, _ROW).join(_block_hits(base, "text", chain([two], blocks)), _ROW, "left")
    both = joined.select("id", "n_words", *(F.concat(c, F.coalesce(x, none[x])).alias(c) for c, x in (("begins", "b"), ("ends", "e"))), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i", none["i"])))).alias("items"))
    return both.mapInArrow(_remerge, _KIND)


def _remerge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merge_spans(np.array(b, np.int64), np.array(e, np.int64)) for b, e in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield table({"id": batch.column(0), "n_words": batch.column(1), "begins": [s[0] for s in spans], "ends": [s[1] for s in spans], "items": batch.column(4)}, _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, begins, ends of an ``occurrences`` result."""
    hit = F.coalesce(F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.size("begins") > 0).alias("contaminated"), "begins", "ends")


def cut_spans(text: bytes, begins: list[int], ends: list[int]) -> bytes:
    """The text without the words of the spans; a line break stands for each."""
    flat = text.translate(_TO_SPACE)
    raw = np.frombuffer(flat, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[0, raw.astype(np.int8), 0]))
    first, last = edge[::2], edge[1::2]
    out, at = [], 0
    for b, e in zip(begins, ends):
        out.append(text[at : first[b]])
        at = last[e - 1]
    out.append(text[at:])
    return b"\n".join(out)


def _with_texts(batch: pa.RecordBatch, texts: list, cut: set[int], text_at: int, chars_at: int | None) -> pa.RecordBatch:
    """The batch with its cut texts; rows of which no word is left go."""
    if not cut:
        return batch
    batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))
    if chars_at is not None:
        f = batch.schema.field(chars_at)
        batch = batch.set_column(chars_at, f, pa.array([len(texts[i]) if i in cut else n for i, n in enumerate(batch.column(chars_at).to_pylist())], f.type))
    gone = [i for i in cut if not words_of(texts[i].encode())]
    return batch.filter(pa.array(~np.isin(np.arange(len(texts)), gone))) if gone else batch


@released
def _cut(batches: Iterator[pa.RecordBatch], items: Items, text_at: int, chars_at: int | None) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in text_slices(b, text_at, 6 * SHARD_WORDS)):
        texts = batch.column(text_at).to_pylist()
        live, cut = list(range(len(texts))), set()
        while live:  # cut ends may meet in a new occurrence; each round shortens the texts that still have one
            raw = [(texts[i] or "").encode() for i in live]
            found = [(i, t, b, e) for i, t, (b, e, _) in zip(live, raw, shard_hits(raw, items)[1]) if b]
            for i, t, b, e in found:
                texts[i] = cut_spans(t, b, e).decode()
            live = [x[0] for x in found]
            cut.update(live)
        yield _with_texts(batch, texts, cut, text_at, chars_at)


@released
def _cut_found(batches: Iterator[pa.RecordBatch], text_at: int, chars_at: int | None) -> Iterator[pa.RecordBatch]:
    """Cut the spans that stand in the last two columns, which go."""
    for batch in batches:
        n = batch.num_columns
        spans = [merge_spans(np.array(b, np.int64), np.array(e, np.int64)) for b, e in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist())]
        texts = [cut_spans(t.encode(), b, e).decode() for t, (b, e) in zip(batch.column(text_at).to_pylist(), spans)]
        yield _with_texts(batch.select(list(range(n - 2))), texts, set(range(len(texts))), text_at, chars_at)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with every occurrence cut from the text; a text of which no word is left becomes empty and its row goes.

    Rows without hits come back as they are. n_chars, where present, follows a cut text. With several blocks the spans
    of all are cut together, and rows that were cut are searched again for all blocks, until a round finds nothing.
    """
    text_at, chars = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    blocks = partial(_blocks, benchmark, item_col, item_text_col, block_chars, window)
    one, two = (*islice(blocks(), 2), None, None)[:2]
    if two is None:
        return docs.mapInArrow(partial(_cut, items=one, text_at=text_at, chars_at=chars), docs.schema) if one else docs
    left, clean = _numbered(docs), []
    while not (hits := _block_hits(left, text_col, blocks()).select(_ROW, "b", "e")).isEmpty():
        clean.append(left.join(hits, _ROW, "left_anti").select(*docs.columns))
        marked = left.join(hits, _ROW).select(*left.columns, "b", "e")
        left = materialize(marked.mapInArrow(partial(_cut_found, text_at=text_at, chars_at=chars), left.schema), "cut")
    return reduce(DataFrame.unionByName, clean, left.select(*docs.columns))
