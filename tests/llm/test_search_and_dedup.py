"""Jaccard join, FM-index, token store and lattice scores against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import fm_index, jaccard_join, lattice_lm, token_store
from tidegauge.llm.common import word_hashes
from tidegauge.llm.components import connected_components

SCHEMA = "text string, doc_id long, id long, source string, cls string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def frame(spark, rows):
    return spark.createDataFrame([(t, i, 7, "s", "x") for i, t in rows], SCHEMA)


def corpus(seed=1, groups=12, words=60):
    """Originals, near copies around the threshold, exact copies, shared passages and odd rows."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(3000)]
    passage = rnd.choices(vocab, k=55)
    rows = []
    for g in range(groups):
        base = rnd.choices(vocab, k=rnd.randint(5, 4 * words))
        rows.append(base)
        for _ in range(rnd.randint(0, 6)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append(w)
        rows.append(base + passage)
        rows.append(rnd.choices(vocab, k=80) + passage + rnd.choices(vocab, k=80))
    texts = [" ".join(w) for w in rows] + ["a b c", "a  b\tc", "A b C", "a b", "", "  \n", None, "x " * 3000, "y\x0bz"]
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts))


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed, 25)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):  # copies of copies: neighbours are near, the ends are not
        if i % 3 == 0:
            base[rnd.randrange(100)] = f"z{i}"
        rows.append((i, " ".join(base)))
    for g in range(40):  # pairs around one common text that is near to neither
        own = [f"p{g}_{j}" for j in range(22)]
        rows += [(200 + 2 * g + k, " ".join([f"w{j}" for j in range(100)] + own + [f"s{g}_{k}"])) for k in (0, 1)]
    rounds = []
    monkeypatch.setattr(jaccard_join, "connected_components", lambda e: rounds.append(1) or connected_components(e))
    rows += [(1000 + i, " ".join(rnd.sample([f"q{j}" for j in range(500)], 120))) for i in range(10)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), small_group=1).collect()}
    assert got == brute_components(rows)
    assert len(rounds) == 2  # the star alone doesn't join them


def test_components_of_odd_tables(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).collect() == []
    got = jaccard_join.jaccard_components(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4)]


def test_weak_documents_still_meet():
    """Few parts are left when most tokens of a set share one: the token prefix then gives the keys."""
    same = np.uint64(3) << np.uint64(20)
    u = np.unique(np.arange(1, 41, dtype=np.uint64) << np.uint64(40) | same | np.arange(40, dtype=np.uint64))
    levels = np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8)
    a, _ = jaccard_join.band_keys(u, levels)
    b, _ = jaccard_join.band_keys(u[3:], levels)
    assert len(np.intersect1d(a, b))


def test_keep_one(spark):
    rows = corpus(3, 15)
    kept = [r.doc_id for r in jaccard_join.keep_one(frame(spark, rows)).collect()]
    want = [d for d, (n, c) in brute_components(rows).items() if n == 0 or d == c]
    assert sorted(kept) == sorted(want)


def test_keep_one_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = a + " tail"
    rows = [(1, a), (2, near), (2, b), (2, ""), (3, c), (3, c), (3, d), (4, b), (None, near), (None, "e f g"), (None, "e f g"), (None, "h i j"), (None, d + " x"), (None, None)]
    rows += [(None, " ".join(f"n{i}" for i in range(60)) + t) for t in ("", " y", "")]
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(frame(spark, rows)).collect()), key=str)
    lone = [r for r in kept if (r[1] or "").startswith("n0 ")]
    assert len(lone) == 1 and lone[0] in rows  # near copies without any id: one of them
    assert [r for r in kept if r not in lone] == sorted([(1, a), (2, b), (2, ""), (3, c), (3, d), (None, "e f g"), (None, "h i j"), (None, None)], key=str)


def test_connected_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(1, 1), (300, 301), (301, 302), (302, 303), (303, 304)]
    low = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.v: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(low[v] == c for v, c in got.items()) and set(got) == {v for a, b in edges if a != b for v in (a, b)}


def test_word_hashes_follow_words():
    text = ("a bb\tbb \x0b a " + "long" * 400_000 + " bb" * 300_000 + "\n").encode()
    h, begin, end = word_hashes(text)
    words = text.split()
    assert [text[i:j] for i, j in zip(begin, end)] == words
    seen = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip(words, h.tolist())) and len(set(seen.values())) == 3
    assert not len(word_hashes(b" \n ")[0])


FM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(docs, items, window=10):
    phrases = {}
    for name, t in items:
        w = FM_WORD.findall(lower(t or ""))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(str(name) if name is not None else "null")
    lens, out = {len(p) for p in phrases}, {}
    for d, t in docs:
        w = FM_WORD.findall(lower(t or ""))
        hit, names = set(), set()
        for n in lens:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit.update(range(i, i + n))
                    names |= phrases[p]
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def fm_case():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choices("abcé9", k=rnd.randint(1, 5))) for _ in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 40)))) for i in range(20)] + [(77, None), (78, "zz top"), (79, "..."), (None, "solo phrase here"), (5, "Zz Top")]
    docs = []
    for i in range(80):
        w = rnd.choices(vocab + ["other"], k=rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            x = (rnd.choice(items)[1] or "").split()
            cut = rnd.randint(0, len(x))
            w += x[cut:] + rnd.choices(vocab, k=3)
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    return docs + [(200, None), (201, ""), (202, "ZZ-top zz top zz"), (203, "zz top " * 500)], items


@pytest.mark.parametrize("block", [fm_index.BLOCK_CHARS, 150])
def test_fm_hits_match_brute_force(spark, block):
    docs, items = fm_case()
    bench = spark.createDataFrame([(t, i, 3) for i, t in items], "text string, item_id long, doc_id long")
    got = fm_index.digest(fm_index.occurrences(frame(spark, docs), bench, block_chars=block)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute_hits(docs, items)


def test_decontaminate_leaves_no_hit(spark):
    docs, items = fm_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = {r.doc_id: r.text for r in fm_index.decontaminate(frame(spark, docs), bench).collect()}
    before = brute_hits(docs, items)
    assert not any(x[4] for x in brute_hits(list(kept.items()), items).values())
    assert all(kept[d] == t for d, t in docs if not before[d][4])
    assert 203 not in kept


@pytest.mark.parametrize("block", [fm_index.BLOCK_CHARS, 1])
def test_fm_blocks_keep_rows_apart(spark, block):
    """Rows that share an id and a word count, and cuts of one block that make or clip an occurrence of another."""
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta eps"), (3, "gamma zeta")], "item_id long, text string")
    texts = ["delta eps one", "one two three", "alpha beta gamma", "x alpha delta eps beta gamma y", "x alpha beta gamma zeta y", None]
    docs = spark.createDataFrame([(t, i, len(t or "")) for t in texts for i in (None, 7)], "text string, doc_id long, n_chars int")
    found = fm_index.digest(fm_index.occurrences(docs, bench, block_chars=block)).collect()
    want = [brute_hits([(0, t)], [(1, "alpha beta gamma"), (2, "delta eps"), (3, "gamma zeta")])[0] for t in texts for _ in (0, 1)]
    assert sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == sorted(want)
    left = fm_index.decontaminate(docs, bench, block_chars=block)
    assert left.columns == docs.columns
    kept = sorted(((r.text, r.doc_id, r.n_chars) for r in left.collect()), key=str)
    # The doc "x alpha delta eps beta gamma y" has an occurrence of item 1 only after its first cut.
    assert kept == sorted([(t, i, len(t or "")) for t in ("\n one", "one two three", "x \n y", "x \n y", None) for i in (None, 7)], key=str)


def test_fm_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert fm_index.occurrences(frame(spark, []), bench).collect() == []
    assert [r.contaminated for r in fm_index.digest(fm_index.occurrences(frame(spark, [(1, "a")]), bench)).collect()] == [False]


def test_wavelet_ranks():
    v = np.random.default_rng(1).integers(0, 37, 500)
    tree = fm_index.WaveletMatrix(v, 6)
    at = np.arange(500)
    symbol, rank = tree.access(at)
    assert (symbol == v).all() and rank.tolist() == [int((v[:i] == v[i]).sum()) for i in at]
    assert tree.rank(np.full(501, 5), np.arange(501)).tolist() == [int((v[:i] == 5).sum()) for i in range(501)]


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_token_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    tok.encode_special_tokens = True
    rows = corpus(2, 6) + [(9, "tabs\t and  double  spaces \n end "), (8, " lead é   x"), (7, "<|endoftext|> x"), (None, "no key"), (9, "second of nine"), (6, "a \u0085b 'll 've  12 3\r\n\r\n  z"), (5, "long " + "w" * 20000)]
    got = token_store.store_documents(frame(spark, rows), tokenizer(), str(tmp_path / "store")).collect()
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    keys = spark.createDataFrame([(9,), (None,), (-5,), (123456,), (5,)], "key long")
    found = {r.key: r.ids for r in token_store.lookup(spark, str(tmp_path / "store"), keys).collect()}
    assert found[-5] is None and found[123456] is None
    assert found[None] == [*tok.encode("no key", add_special_tokens=False).ids, 2]
    assert len(found[9]) == sum(w[2] for w in want if w[0] == 9)


def test_token_store_of_no_rows(spark, tmp_path):
    assert token_store.store_documents(frame(spark, []), tokenizer(), str(tmp_path / "e")).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**62, 5000))
    mph = token_store.PerfectHash.from_bytes(token_store.PerfectHash.build(keys).to_bytes())
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def lattice_model():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    p = lattice_lm.Pieces(["a", "b", "ab", "ba", "aba"], np.log(np.r_[0.2, 0.1, 0.15, 0.05, 0.1, np.full(256, 1e-3)]))

    def total(w):
        return 1.0 if not w else sum(math.exp(p.logp[k]) * total(w[len(x) :]) for x, k in p.index.items() if w.startswith(x))

    for w in ("a", "ab", "abab", "ababa", "bbaab"):
        assert math.isclose(math.exp(lattice_lm.forward(p.arcs(w))[-1]), total(w), rel_tol=1e-9)
    assert math.isclose(lattice_lm.forward(p.arcs("é"))[-1], 2 * math.log(1e-3))
    counts = [0.0] * len(p.logp)
    lattice_lm.expected_counts("ababa", 2.0, p, counts)
    assert math.isclose(sum(c * len(x) for c, x in zip(counts, p.pieces)), 10.0)
    paths = []

    def walk(w, prob, used):
        if not w:
            paths.append((prob, used))
        for x, k in p.index.items():
            if w.startswith(x):
                walk(w[len(x) :], prob * math.exp(p.logp[k]), [*used, k])

    walk("ababa", 1.0, [])
    whole = sum(x for x, _ in paths)
    for k in range(5):
        assert math.isclose(counts[k], 2 * sum(x * u.count(k) for x, u in paths) / whole, rel_tol=1e-9)


def test_lattices_of_many_words_match_single_ones():
    rnd = random.Random(3)
    p = lattice_lm.Pieces.load(lattice_model())
    words = ["▁" + "".join(rnd.choices("theanérß漢😀.,", k=rnd.randint(0, 14))) for _ in range(400)] + ["▁" + "anth" * 30, "▁the"]
    many = lattice_lm.Lattices(p)
    assert np.allclose(many.scores(words), [lattice_lm.forward(p.arcs(w))[-1] for w in words], rtol=1e-12)
    weights = np.array([rnd.randint(1, 9) for _ in words])
    got, want = np.zeros(len(p.logp)), [0.0] * len(p.logp)
    many.add_expected(words, weights, got)
    for w, x in zip(words, weights.tolist()):
        lattice_lm.expected_counts(w, x, p, want)
    assert np.allclose(got, want)


def test_lattice_scores(spark):
    rows = [r for r in corpus(6, 20)] + [(None, "no key here")]
    got = {r.doc_id: r for r in lattice_lm.lattice_scores(frame(spark, rows), lattice_model()).collect()}
    held = {d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, _ in rows}
    count = Counter()
    for d, t in rows:
        if not held[d]:
            count.update([*WORD.findall(lower(t or "")), None])
    n, v = sum(count.values()), len(count)
    for d, t in rows:
        toks = [*WORD.findall(lower(t or "")), None]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(toks), sum(x in count for x in toks), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert any(held.values())


def test_lattice_scores_of_no_rows(spark):
    assert lattice_lm.lattice_scores(frame(spark, []), lattice_model()).collect() == []


def test_lattice_scores_are_plain_sums(spark):
    """The whole score again: three plain expectation rounds over the training words, then forward sums a word."""
    rows = [*corpus(6, 20), (None, "no key here"), (7, ""), (8, None), (9, "Ünï Zz zz"), (9, "Ünï Zz zz")]
    trained = [lower(t or "") for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 10]
    count = Counter(w for t in trained for w in WORD.findall(t))
    p = lattice_lm.Pieces.load(lattice_model())
    for _ in range(3):
        mass = [0.1] * len(p.logp)
        for w, n in count.items():
            lattice_lm.expected_counts("▁" + w, n, p, mass)
        total = sum(mass) + len(trained) + 0.1
        p = lattice_lm.Pieces(p.pieces, np.log(np.array(mass) / total))
    want = []
    for d, t in rows:
        words = sum(lattice_lm.forward(p.arcs("▁" + w))[-1] for w in WORD.findall(lower(t or "")))
        want.append((-1 if d is None else d, words / math.log(10) + math.log10((len(trained) + 0.1) / total)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.score) for r in lattice_lm.lattice_scores(frame(spark, rows), lattice_model()).collect()]
    assert len(got) == len(want)
    for (a, x), (b, y) in zip(sorted(got), sorted(want)):
        assert a == b and math.isclose(x, y, rel_tol=1e-9), (a, x, y)
