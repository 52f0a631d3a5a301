"""Language-model scores of whole texts by a subword lattice.

The pieces are those of a fixed public vocabulary. Its own scores are merge ranks and no unigram scores (none are at
hand), so they only give starting probabilities, by a Zipf law; the unigram probabilities used are fitted by three expectation
steps over all training words, each weighted by its count. A text's probability is the product over its words of the sum over all segmentations into
pieces (forward recursion in logarithms), times the end's probability. Characters outside the vocabulary fall
back to byte pieces.

Only distinct words of a block of documents travel, packed by hash range: the counts come back to the block, where
documents hold local word ids. So a word that is in every document costs one entry a block.

Null text is empty: one token, the end. Null doc_id has the text "" for the held-out rule. Repeated rows count
each. An empty training side gives counts of zero and uniform smoothing. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import IdCache, hash_parts, materialize, released, table

#: Words of documents in a block.
BLOCK_WORDS = 3_000_000
#: Expectation steps over all training words.
ROUNDS = 3
#: Added to counts of tokens and of pieces.
ALPHA = 0.1
#: The mark that the vocabulary puts for white space before a word.
SPACE = "▁"
LN10 = math.log(10)


class Pieces:
    """A piece vocabulary with natural-log probabilities; bytes are the last 256 entries."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.pieces, self.logp = pieces, [float(x) for x in logp]
        self.index = {p: i for i, p in enumerate(pieces)}
        self.reach = dict.fromkeys((p[:n] for p in pieces for n in range(1, len(p))), -1) | self.index  # -1: only begins a piece
        self.longest = max(map(len, pieces), default=1)
        self.byte0 = len(pieces)

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """Pieces of a sentencepiece model; its scores are ranks, read as a Zipf law."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        rank = np.array([-sp.get_score(i) for i in ids])
        weight = np.r_[1 / (10 + rank - rank.min()), np.full(256, 1e-7)]
        return cls([sp.id_to_piece(i) for i in ids], np.log(weight / weight.sum()))

    def arcs(self, word: str) -> list[list[tuple[int, int, float]]]:
        """For each end position, (start, piece or -1 for bytes, log probability) of what ends there."""
        find, logp, n = self.reach.get, self.logp, len(word)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        for i in range(n):
            for j in range(i, n):
                k = find(word[i : j + 1])
                if k is None:
                    break
                if k >= 0:
                    out[j].append((i, k, logp[k]))
            if not out[i] or out[i][-1][0] != i:
                out[i].append((i, -1, sum([logp[self.byte0 + b] for b in word[i].encode()])))
        return out


def forward(arcs: list[list[tuple[int, int, float]]]) -> list[float]:
    """Log of the summed probability of all segmentations of each prefix."""
    a, exp, log = [0.0], math.exp, math.log
    for here in arcs:
        if len(here) == 1:
            a.append(a[here[0][0]] + here[0][2])
            continue
        terms = [a[i] + p for i, _, p in here]
        top = max(terms)
        a.append(top + log(sum([exp(t - top) for t in terms])))
    return a


def expected_counts(word: str, weight: float, pieces: Pieces, into: list[float]) -> None:
    """Add ``weight`` times the expected number of uses of each piece in the word."""
    arcs = pieces.arcs(word)
    a, n = forward(arcs), len(word)
    share, exp = [0.0] * n + [weight], math.exp  # expected passes through each position
    for j in range(n, 0, -1):
        through, here, at = share[j], arcs[j - 1], a[j]
        for i, k, p in here:
            part = through * exp(a[i] + p - at) if len(here) > 1 else through
            share[i] += part
            if k >= 0:
                into[k] += part
            else:
                for x in word[i].encode():
                    into[pieces.byte0 + x] += part


#: Words longer than this go one by one; cells (words times characters) of a batch of equal length.
LONGEST_BATCHED, CELLS = 48, 300_000
_MULT, _SLOT = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class Lattices:
    """The same recursions for many words of one length at a time, as arrays."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.logp = pieces, np.array(pieces.logp)
        self.keys = np.zeros(len(pieces.pieces) + 1, np.uint64)
        for k, p in enumerate(pieces.pieces):
            h = 0
            for c in p:
                h = (h * int(_MULT) + ord(c) + 1) & (2**64 - 1)
            self.keys[k] = h
        self.slots = [np.full(1 << 20, -1, np.int32) for _ in _SLOT]  # a piece whose first slot is taken goes to its second
        self.crowded = {}
        ids = np.arange(len(pieces.pieces))
        for table, odd in zip(self.slots, _SLOT):
            at = ((self.keys[ids] * odd) >> np.uint64(44)).astype(np.int64)
            table[at[::-1]] = ids[::-1]
            ids = ids[table[at] != ids]
        self.crowded = {int(self.keys[k]): int(k) for k in ids}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each substring hash, -1 for none."""
        out = np.full(len(h), -1, np.int64)
        for table, odd in zip(self.slots, _SLOT):
            k = table[((h * odd) >> np.uint64(44)).astype(np.int64)]
            hit = (k >= 0) & (self.keys[k] == h)
            out[hit] = k[hit]
        for key, k in self.crowded.items():
            out[h == np.uint64(key)] = k
        return out

    def arcs(self, words: list[str]) -> tuple[np.ndarray, list[list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Code points, and for each end position (start, pieces, log probabilities) over all words."""
        n, size = len(words), len(words[0])
        chars = np.array(words, f"<U{size}").view(np.uint32).reshape(n, size)
        code = chars.astype(np.uint64) + np.uint64(1)
        out: list = [[] for _ in range(size)]
        for i in range(size):
            h = np.zeros(n, np.uint64)
            for j in range(i, min(size, i + self.pieces.longest)):
                h = h * _MULT + code[:, j]
                k = self.find(h)
                if j == i or (k >= 0).any():
                    p = np.where(k >= 0, self.logp[k], -np.inf)
                    if j == i and (k < 0).any():
                        some, back = np.unique(chars[k < 0, i], return_inverse=True)
                        p[k < 0] = np.array([sum(self.pieces.logp[self.pieces.byte0 + b] for b in chr(c).encode("utf-8", "replace")) for c in some])[back]
                    out[j].append((i, k, p))
        return chars, out

    @staticmethod
    def forward(n: int, arcs: list) -> np.ndarray:
        a = np.zeros((len(arcs) + 1, n))
        for j, here in enumerate(arcs, 1):
            terms = np.stack([a[i] + p for i, _, p in here])
            top = terms.max(0)
            a[j] = top + np.log(np.exp(terms - top).sum(0))
        return a

    def expect(self, chars: np.ndarray, arcs: list, weights: np.ndarray, into: np.ndarray) -> None:
        a, size = self.forward(len(weights), arcs), len(arcs)
        share = np.zeros((size + 1, len(weights)))
        share[size] = weights
        for j in range(size, 0, -1):
            for i, k, p in arcs[j - 1]:
                part = share[j] * np.exp(a[i] + p - a[j])
                share[i] += part
                known = k >= 0
                into += np.bincount(k[known], part[known], len(into))
                if j == i + 1 and not known.all():
                    some, back = np.unique(chars[~known, i], return_inverse=True)
                    for c, x in zip(some.tolist(), np.bincount(back, part[~known]).tolist()):
                        for b in chr(c).encode("utf-8", "replace"):
                            into[self.pieces.byte0 + b] += x

    def batches(self, words: list[str]) -> Iterator[np.ndarray]:
        """Positions of words of one length, in batches; long words alone."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        edge = np.r_[np.flatnonzero(np.r_[True, np.diff(lens[order]) > 0]), len(order)] if len(order) else np.zeros(1, np.int64)
        for lo, hi in zip(edge[:-1], edge[1:]):
            size = int(lens[order[lo]])
            step = max(1, CELLS // size) if size <= LONGEST_BATCHED else 1
            for at in range(int(lo), int(hi), step):
                yield order[at : min(at + step, int(hi))]

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, all segmentations together."""
        out = np.zeros(len(words))
        for at in self.batches(words):
            part = [words[x] for x in at.tolist()]
            out[at] = self.forward(len(part), self.arcs(part)[1])[-1] if len(part[0]) <= LONGEST_BATCHED else forward(self.pieces.arcs(part[0]))[-1]
        return out

    def add_expected(self, words: list[str], weights: np.ndarray, into: np.ndarray) -> None:
        for at in self.batches(words):
            part = [words[x] for x in at.tolist()]
            if len(part[0]) <= LONGEST_BATCHED:
                self.expect(*self.arcs(part), weights[at].astype(float), into)
            else:
                own = [0.0] * len(into)
                expected_counts(part[0], float(weights[at[0]]), self.pieces, own)
                into += own


def spelled(blob: bytes) -> list[str]:
    """The words of a blob, each with the mark of the space before it."""
    return [SPACE + w for w in blob.decode("utf-8", "replace").split("\n")]


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


_BLOCK = pa.schema([("block", pa.string()), ("p", pa.int32()), ("words", pa.binary()), ("idx", pa.binary()), ("counts", pa.binary()), ("docs", pa.list_(pa.int64())), ("lens", pa.binary()), ("local", pa.binary())])


@released
def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents as local word ids, and each block's distinct words with their training counts by range."""
    part = TaskContext.get().partitionId()
    number, size = 0, 0
    ids, docs, arrays = IdCache(), [], []

    def flush() -> Iterator[pa.RecordBatch]:
        name = f"{part}-{number}"
        train = [a for d, a in zip(docs, arrays) if not held_out(d)]
        counts = np.bincount(np.concatenate(train), minlength=len(ids)) if train else np.zeros(len(ids), np.int64)
        words = list(ids)
        p = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(parts)
        order = np.argsort(p, kind="stable")
        p = p[order]
        at = np.r_[np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), len(p)] if len(p) else np.zeros(1, np.int64)
        for i, j in zip(at[:-1], at[1:]):
            o = order[i:j]
            yield table({"block": [name], "p": [int(p[i])], "words": [b"\n".join([words[x] for x in o.tolist()])], "idx": [o.astype("<i4").tobytes()], "counts": [counts[o].astype("<i8").tobytes()], "docs": [None], "lens": [None], "local": [None]}, _BLOCK)
        lens = np.array([len(a) for a in arrays], "<i4")
        local = np.concatenate(arrays).astype("<i4")
        yield table({"block": [name], "p": [-1], "words": [None], "idx": [None], "counts": [None], "docs": [docs], "lens": [lens.tobytes()], "local": [local.tobytes()]}, _BLOCK)

    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = (t or b"").lower().split()
            docs.append(d)
            arrays.append(np.fromiter(map(ids.__getitem__, w), np.int32, len(w)))
            size += len(w) + 1
            if size >= BLOCK_WORDS:
                yield from flush()
                number, size = number + 1, 0
                ids, docs, arrays = IdCache(), [], []
    if docs:
        yield from flush()


_VOCAB = pa.schema([("p", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("n_train", pa.int64()), ("v_train", pa.int64())])


def _vocabulary(t: pa.Table) -> pa.Table:
    """The distinct words of a hash range with their training counts."""
    ids, lists = IdCache(), []
    counts = np.zeros(0, np.int64)
    for w, c in zip(t.column("words"), t.column("counts")):
        words = w.as_py().split(b"\n")
        at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        lists.append((at, np.frombuffer(c.as_py(), "<i8")))
    counts = np.bincount(np.concatenate([a for a, _ in lists]), np.concatenate([c for _, c in lists]).astype(np.float64), len(ids)).astype(np.int64)
    return pa.table({"p": pa.array([t.column("p")[0].as_py()], pa.int32()), "words": pa.array([b"\n".join(ids)], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "n_train": pa.array([int(counts.sum())]), "v_train": pa.array([int((counts > 0).sum())])}, schema=_VOCAB)


EM_CHUNK = 2048


@released
def _expect(batches: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    total, lattices = np.zeros(len(pieces.logp)), Lattices(pieces)
    for batch in batches:
        for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, counts = spelled(w), np.frombuffer(c, "<i8")
            used = np.flatnonzero(counts)
            lattices.add_expected([words[x] for x in used.tolist()], counts[used], total)
    for k in range(0, len(total), EM_CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + EM_CHUNK].tobytes()], pa.binary())], names=["k", "v"])


def _add(t: pa.Table) -> pa.Table:
    return pa.table({"k": pa.array([t.column("k")[0].as_py()], pa.int32()), "v": pa.array([np.sum([np.frombuffer(x) for x in t.column("v").to_pylist()], 0).tobytes()], pa.binary())})


_ANSWER = pa.schema([("block", pa.string()), ("idx", pa.binary()), ("c", pa.binary()), ("s", pa.binary())])


def _answer(asked: pa.Table, vocab: pa.Table, pieces: Pieces) -> pa.Table:
    """Count and lattice log probability of every word of a hash range, for each block that holds it."""
    if not asked.num_rows:
        return _ANSWER.empty_table()
    words = [w for x in vocab.column("words") for w in x.as_py().split(b"\n")]
    counts = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in vocab.column("counts")])
    scores = Lattices(pieces).scores([x for b in vocab.column("words") for x in spelled(b.as_py())])
    at = {w: i for i, w in enumerate(words)}
    blocks, c, s = [], [], []
    for x in asked.column("words"):
        k = [at[w] for w in x.as_py().split(b"\n")]
        c.append(counts[k].tobytes())
        s.append(scores[k].tobytes())
    return pa.table({"block": asked.column("block"), "idx": asked.column("idx"), "c": pa.array(c, pa.binary()), "s": pa.array(s, pa.binary())}, schema=_ANSWER)


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(docs: pa.Table, answers: pa.Table, train_tokens: int, distinct: int, train_docs: int, end: float) -> pa.Table:
    if not docs.num_rows:
        return _SCORES.empty_table()
    n = 1 + max((int(np.frombuffer(x.as_py(), "<i4").max()) for x in answers.column("idx")), default=-1)
    base, score, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for i, c, s in zip(answers.column("idx"), answers.column("c"), answers.column("s")):
        i, c = np.frombuffer(i.as_py(), "<i4"), np.frombuffer(c.as_py(), "<i8")
        base[i], known[i], score[i] = np.log10(c + ALPHA), c > 0, np.frombuffer(s.as_py()) / LN10
    norm, last = math.log10(train_tokens + ALPHA * (distinct + 1)), math.log10(train_docs + ALPHA)
    out = []
    for row in range(docs.num_rows):
        ids = docs.column("docs")[row].as_py()
        lens = np.frombuffer(docs.column("lens")[row].as_py(), "<i4").astype(np.int64)
        local = np.frombuffer(docs.column("local")[row].as_py(), "<i4")
        stop = np.cumsum(lens)
        sums = []
        for values in (base, known, score):
            flat = values[local] if len(local) else np.zeros(0)
            full = np.flatnonzero(lens)
            got = np.zeros(len(lens), flat.dtype)
            if len(full):
                got[full] = np.add.reduceat(flat, (stop - lens)[full])
            sums.append(got)
        tokens = lens + 1
        out.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(d) for d in ids]), "n_tokens": tokens, "n_known": sums[1].astype(np.int64) + (train_docs > 0), "train_tokens": np.full(len(ids), train_tokens, np.int64), "base_score": sums[0] + last - tokens * norm, "score": sums[2] + end}, schema=_SCORES))
    return pa.concat_tables(out)


def lattice_scores(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per document."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    blocks = materialize(base.mapInArrow(partial(_blocks, parts=hash_parts(spark)), "block string, p int, words binary, idx binary, counts binary, docs array<long>, lens binary, local binary"), "blocks")
    asked = blocks.where("p >= 0").select("block", "p", "words", "idx")
    vocab = materialize(blocks.where("p >= 0").select("p", "words", "counts").groupBy("p").applyInArrow(_vocabulary, "p int, words binary, counts binary, n_train long, v_train long"), "vocabulary")
    totals = vocab.agg(F.sum("n_train").alias("n"), F.sum("v_train").alias("v")).first()
    train_docs = base.where(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 10 != 0).count()
    pieces, total = Pieces.load(model_file), 1.0
    counted = vocab.select("p", "words", "counts").repartition(hash_parts(spark, 1), "p").select("words", "counts")
    for _ in range(rounds):
        sums = counted.mapInArrow(partial(_expect, pieces=pieces), "k int, v binary").groupBy("k").applyInArrow(_add, "k int, v binary").collect()  # as long as the vocabulary
        mass = np.full(len(pieces.logp), ALPHA)
        for r in sums:
            mass[r["k"] : r["k"] + EM_CHUNK] += np.frombuffer(bytes(r["v"]))
        total = mass.sum() + train_docs + ALPHA  # the end is one more piece
        pieces = Pieces(pieces.pieces, np.log(mass / total))
    train_tokens, distinct = (totals["n"] or 0) + train_docs, (totals["v"] or 0) + (train_docs > 0)
    answers = asked.groupBy("p").cogroup(vocab.groupBy("p")).applyInArrow(partial(_answer, pieces=pieces), "block string, idx binary, c binary, s binary")
    texts = blocks.where("p < 0").select("block", "docs", "lens", "local")
    last = partial(_score, train_tokens=train_tokens, distinct=distinct, train_docs=train_docs, end=math.log10((train_docs + ALPHA) / total))
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(last, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
