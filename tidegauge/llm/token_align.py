"""Alignment of two tokenizers' tokens over the same bytes, with counts of linked id pairs.

Side A is a byte-level BPE vocabulary (its tokenizer takes a space and the text), side B a piece vocabulary (it adds
that space itself). A token's bytes are those of its entry, so the cumulative token ends of both sides lie on one
scale. A merge of the two rising lists of ends finds the offsets where tokens of both sides end: they cut the tokens
into groups, and the two tokens that end there are linked. Spark then counts linked id pairs over all documents and
joins each pair's count and both sides' maxima back to the links.

Both tokenizers work word by word: neither gives a token that goes on behind a space between two non-spaces. So the
texts of a slice become a dictionary of words, each distinct word is encoded and aligned once, and a document's
groups are those of its words in order. A text with other runs of white space is one such word as a whole.

Linked tokens end together and lie in the same bytes, so one's bytes are a suffix of the other's. An entry of n bytes has
at most n suffixes, so there are no more distinct pairs than the two vocabularies have bytes (a few times that where
entries share their bytes): the table of pairs has a bound that no corpus moves, and is broadcast.

Null and empty texts have no tokens, nor has a text whose joined A or B bytes aren't space and text: counts are zero and
groups is empty. Invalid UTF-8 is read with replacement signs. Repeated rows and null ids are documents of their own.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import materialize, released, text_slices
from tidegauge.llm.token_store import _TIGHT, Encoder

#: Bytes of text aligned at a time.
SLICE_BYTES = 6_000_000
#: A link travels as one number: how often the document has it, the A id, the B id.
ID_BITS = 17
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>"


def byte_alphabet() -> dict[str, int]:
    """The sign of a byte-level vocabulary for each byte: printable Latin-1 stands for itself, the rest for signs from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One vocabulary's entries: bytes of each id, and how an id is written inside and at the end of a group's half."""

    def __init__(self, entries: list[bytes], close: str):
        self.entries = entries
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.written = [s for i in range(len(entries)) for s in (f"{i},", f"{i}{close}")]


class Aligner:
    """Groups and links of texts."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece

        self.enc = Encoder(a_file, 4)
        tok, alphabet = self.enc.tok, byte_alphabet()
        names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
        self.a = Side([bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in names], "|")
        self.sp = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.b = Side([bytes([int(x[3:5], 16)]) if self.sp.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)], ";")
        if max(len(self.a.entries), len(self.b.entries)) >= 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.written = self.a.written + self.b.written
        self.width = np.fromiter(map(len, self.written), np.int64, len(self.written))

    def words(self, words: list[str], whole: list[str], again: list[bool]) -> Words:
        """Each word (or whole text) aligned."""
        a = self.enc.words(words, again) + [self.enc.whole(" " + x) for x in whole]
        b = self.sp.encode(words + whole, num_threads=1) if words or whole else []
        said = [b" " + x.encode() for x in chain(words, whole)]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) // w for x, w in ((a, 4), (b, 1)))
        ids_a, ids_b = np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        same = [self._same(self.a, ids_a, n_a, said), self._same(self.b, ids_b, n_b, said)]
        good = same[0] & same[1]
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        return Words(self, ids_a, ids_b, n_a, n_b, good)

    @staticmethod
    def _same(side: Side, ids: np.ndarray, n: np.ndarray, said: list[bytes]) -> np.ndarray:
        """Whether a word's tokens join to its bytes."""
        joined = b"".join([side.entries[i] for i in ids.tolist()])
        ends = np.r_[0, np.cumsum(side.size[ids])][np.cumsum(n)]
        starts = np.r_[0, ends[:-1]]
        size = np.fromiter(map(len, said), np.int64, len(said))
        if joined == b"".join(said) and (ends - starts == size).all():
            return np.ones(len(said), bool)
        return np.array([joined[i:j] == w for i, j, w in zip(starts.tolist(), ends.tolist(), said)], bool)


class Words:
    """Aligned words: how many tokens, groups and links each has, its groups as text, its linked pairs."""

    def __init__(self, al: Aligner, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, good: np.ndarray):
        self.n_a, self.n_b, self.good = n_a, n_b, good
        # Ends of the words' tokens one behind the other: both sides rise alike, and meet at least at each word's end.
        ends_a, ends_b = np.cumsum(al.a.size[ids_a]), np.cumsum(al.b.size[ids_b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(len(ends_a), bool)
        i = np.flatnonzero(last_a)
        j = at[i]
        last_b = np.zeros(len(ends_b), bool)
        last_b[j] = True
        self.pairs = (ids_a[i] << ID_BITS) | ids_b[j]
        first = np.r_[0, np.cumsum(n_a)]
        self.n_links = np.r_[0, np.cumsum(last_a)][first[1:]] - np.r_[0, np.cumsum(last_a)][first[:-1]]
        # A group is written as its A ids, then its B ids: a token's place follows from how many of the other side go before.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.r_[0, j + 1][group_a]] = 2 * ids_a + last_a
        order[np.arange(len(ids_b)) + (i + 1)[group_b]] = 2 * (ids_b + len(al.a.entries)) + last_b
        text = "".join([al.written[c] for c in order.tolist()])
        stops = np.r_[0, np.cumsum(al.width[order])][np.cumsum(n_a + n_b)].tolist()
        self.text = [text[i:j] for i, j in zip([0, *stops[:-1]], stops)]


def _documents(al: Aligner, ids: pa.Array, texts: pa.Array) -> pd.DataFrame:
    """The rows of a slice of documents."""
    spaced = pc.binary_join_element_wise("", pc.fill_null(texts, ""), " ")
    tight = pc.fill_null(pc.match_substring_regex(spaced, _TIGHT), False).to_numpy(zero_copy_only=False)
    empty = pc.equal(spaced, " ").to_numpy(zero_copy_only=False)
    loose = pc.filter(texts, pa.array(~tight & ~empty))
    split = pc.split_pattern(loose, " ")
    coded = pc.dictionary_encode(split.flatten())
    words = coded.dictionary.to_pylist()
    place = coded.indices.to_numpy()
    again = np.bincount(place, minlength=len(words)) > 1
    whole = pc.filter(texts, pa.array(tight & ~empty)).to_pylist()
    w = al.words(words, whole, again.tolist())
    counts = np.zeros(len(texts), np.int64)  # words of each document
    counts[~tight & ~empty] = np.diff(split.offsets.to_numpy())
    counts[tight & ~empty] = 1
    doc = np.repeat(np.arange(len(texts)), counts)
    word = np.empty(len(doc), np.int64)
    own = np.repeat(tight, counts)
    word[own], word[~own] = np.arange(len(whole)) + len(words), place
    bad = np.bincount(doc, ~w.good[word], minlength=len(texts)) > 0
    kept = ~bad[doc]
    doc, word = doc[kept], word[kept]
    total = lambda n: np.bincount(doc, n[word], minlength=len(texts)).astype(np.int64)
    edge = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))].tolist()
    said = [w.text[i] for i in word.tolist()]
    groups = ["".join(said[i:j])[:-1] for i, j in zip(edge[:-1], edge[1:])]
    # A document's links, each pair once with its number.
    n = w.n_links[word]
    begin = (np.cumsum(w.n_links) - w.n_links)[word]
    flat = w.pairs[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    by_doc = np.r_[0, np.cumsum(total(w.n_links))].tolist()
    links = [_counted(flat[i:j]) for i, j in zip(by_doc[:-1], by_doc[1:])]
    n_links = total(w.n_links)
    return pd.DataFrame({"doc_id": ids.to_pandas(integer_object_nulls=True).astype("Int64"), "n_a": total(w.n_a), "n_b": total(w.n_b), "n_groups": n_links, "n_links": n_links, "groups": groups, "links": links})


def _counted(pairs: np.ndarray) -> np.ndarray:
    each, n = np.unique(pairs, return_counts=True)
    return (n.astype(np.int64) << 2 * ID_BITS) | each


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


@released
def _align(frames: Iterator[pd.DataFrame], a_file: str, b_file: str) -> Iterator[pd.DataFrame]:
    al = _ALIGNERS.get((a_file, b_file)) or _ALIGNERS.setdefault((a_file, b_file), Aligner(a_file, b_file))
    for frame in frames:
        batch = pa.RecordBatch.from_arrays([pa.array(frame["doc_id"], pa.int64(), from_pandas=True), pa.array(frame["text"], pa.string(), from_pandas=True)], names=["doc_id", "text"])
        for rows in text_slices(batch, 1, SLICE_BYTES):
            yield _documents(al, rows.column(0), rows.column(1))


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), links (see ``linked``) of each document."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return base.mapInPandas(partial(_align, a_file=a_file, b_file=b_file), SCHEMA)


def linked(aligned: DataFrame, *keys: str) -> DataFrame:
    """keys, pair, n: a row for each distinct linked pair of a document, with how many links hold it."""
    each = aligned.select(*keys, F.explode("links").alias("__l"))
    return each.select(*keys, F.col("__l").bitwiseAND(F.lit((1 << 2 * ID_BITS) - 1)).alias("pair"), F.shiftright("__l", 2 * ID_BITS).alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a_id, b_id, count, a_max, b_max: links of each pair over all documents, and the highest count of either id."""
    pairs = linked(aligned).groupBy("pair").agg(F.sum("n").alias("count"))
    pairs = pairs.select("pair", F.shiftright("pair", ID_BITS).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b_id"), "count")
    counted = materialize(pairs, "pairs")  # bounded by the vocabularies, see above
    top = lambda side: F.broadcast(counted.groupBy(f"{side}_id").agg(F.max("count").alias(f"{side}_max")))
    return counted.join(top("a"), "a_id").join(top("b"), "b_id")


def alignment_report(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    found = align(docs, a_file, b_file, id_col, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = materialize(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"), "aligned")
    counts = pair_counts(aligned).select("pair", "count", (F.col("count") == F.col("b_max")).alias("best"))
    each = linked(aligned, "row").join(F.broadcast(counts), "pair")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    out = aligned.drop("links").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
