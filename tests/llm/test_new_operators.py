"""Exact dedup, token alignment and conversation repair against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import conversation_repair, exact_dedup, token_align
from tidegauge.llm.common import join_spread
from tidegauge.llm.queries import tokenizer_file

SCHEMA = "text string, doc_id long, digest string, row long, kept boolean"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts_with_copies(seed=3):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choices("ab \n", k=rnd.randint(0, 4))) for _ in range(300)] + ["hot text"] * 200 + [None, None, "", "x" * 400_000, "x" * 400_000, "x" * 399_999 + "y", "Hot text", "hot text "]
    rnd.shuffle(texts)
    ids = list(range(50, 50 + len(texts)))
    rnd.shuffle(ids)
    return list(zip(texts, ids))


def plain_dedup(rows):
    by_text = {}
    for t, i in rows:
        by_text.setdefault(t or "", []).append(i)
    return sorted((i, max(by_text[t or ""]), len(by_text[t or ""]), i == max(by_text[t or ""]), sha(t or "")) for t, i in rows)


@pytest.mark.parametrize("kw", [{}, {"heavy": 3, "salts": 2}, {"digest": lambda h: F.substring(h, 1, 1)}, {"digest": lambda h: F.lit("same"), "heavy": 2}, {"digest": lambda h: F.substring(h, 1, 2), "heavy": 100_000}], ids=["sha256", "heavy", "weak", "constant", "all heavy"])
def test_exact_groups(spark, kw):
    rows = texts_with_copies()
    docs = spark.createDataFrame([(t, i, "d", 1, False) for t, i in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, exact_dedup.dedup_report(docs, **kw).collect()))
    assert got == plain_dedup(rows)
    left = sorted((r["doc_id"], r["text"] or "") for r in exact_dedup.deduplicate(docs, **kw).collect())
    assert left == sorted((i, t or "") for t, i in rows if (i, True) in {(x[0], x[3]) for x in got})
    assert exact_dedup.deduplicate(docs, **kw).columns == docs.columns


def test_exact_dedup_of_odd_rows(spark):
    odd = [("a", None), ("a", None), ("b", None), ("b", 4), ("c", 7), ("c", 7), ("c", 7), (None, None), ("d", 1)]
    docs = spark.createDataFrame([(t, i, "d", 1, False) for t, i in odd], SCHEMA)
    for kw in ({}, {"digest": lambda h: F.lit("same")}):
        got = exact_dedup.dedup_report(docs, **kw).collect()
        kept = Counter((r["doc_id"], r["text_sha256"]) for r in got if r["kept"])
        assert kept == Counter({(None, sha("a")): 1, (4, sha("b")): 1, (7, sha("c")): 1, (None, sha("")): 1, (1, sha("d")): 1})
        assert {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in got} == {(sha("a"), None, 2), (sha("b"), 4, 2), (sha("c"), 7, 3), (sha(""), None, 1), (sha("d"), 1, 1)}
        assert len(got) == len(odd) and exact_dedup.deduplicate(docs, **kw).count() == 5
    assert exact_dedup.dedup_report(docs.limit(0)).collect() == [] and exact_dedup.deduplicate(docs.limit(0)).collect() == []
    folded = exact_dedup.dedup_report(spark.createDataFrame([("A ", 1), ("a", 2)], "text string, doc_id long"), normalise=lambda t: F.lower(F.trim(t))).collect()
    assert {(r["doc_id"], r["keep_id"], r["text_sha256"]) for r in folded} == {(1, 2, sha("a")), (2, 2, sha("a"))}


def test_heavy_keys_are_spread(spark):
    left = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(3000)], "key string, i long")
    right = left.groupBy("key").count().withColumn("name", F.upper("key"))
    out = join_spread(left, right.where("count <> 1 or key < 'k2'"), "key", "count", 3000, F.col("i"), heavy=20)
    assert [(r["key"], r["i"], r["count"], r["name"]) for r in out.orderBy("i").collect()] == [("h", i, 2000, "H") if i % 3 else (f"k{i}", i, *((1, f"K{i}") if f"k{i}" < "k2" else (None, None))) for i in range(3000)]


SIGNS = ["a", "b", "the", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "ß", "日本", "😀", "▁", "'s", "don't", ".", "...", "!", "12", "3456", "<|endoftext|>", "</s>", "<0x41>", "\x00", "　", "ﬁ", "é", "\r\n", "\x1c", "​", "﻿", "_", "’"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    alphabet = token_align.byte_alphabet()

    def a_bytes(i):
        return bytes(alphabet[c] for c in tok.id_to_token(i))

    def b_bytes(i):
        p = pieces.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    return (lambda t: tok.encode(" " + t, add_special_tokens=False).ids, a_bytes), (lambda t: pieces.encode(t), b_bytes)


def plain_alignment(text, libraries):
    """Token ids of both sides by whole texts, walked with two pointers: groups, links."""
    if not text:
        return 0, 0, [], []
    (enc_a, bytes_a), (enc_b, bytes_b) = libraries
    a, b = enc_a(text), enc_b(text)
    if not b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + text).encode():
        return 0, 0, [], []
    groups, links, left, right, i, j, at_a, at_b = [], [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            left.append(a[i])
            at_a, i = at_a + len(bytes_a(a[i])), i + 1
        else:
            right.append(b[j])
            at_b, j = at_b + len(bytes_b(b[j])), j + 1
        if at_a == at_b:
            groups.append((left, right))
            links.append((left[-1], right[-1]))
            left, right = [], []
    return len(a), len(b), groups, links


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def odd_texts(n, seed=11):
    rnd = random.Random(seed)
    loose = ["".join(rnd.choices(SIGNS, k=rnd.randint(1, 25))) for _ in range(n)]
    words = [" ".join(rnd.choices([x for x in SIGNS if x.strip()], k=rnd.randint(1, 60))) for _ in range(n)]
    return [None, "", " ", " a", "a ", "a", "\n", "very " * 30_000 + "long", *loose, *words]


def test_alignment_of_a_slice(libraries):
    al = token_align.Aligner(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    texts = odd_texts(400)
    got = token_align._documents(al, pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()))
    seen = 0
    for text, row in zip(texts, got.itertuples()):
        n_a, n_b, groups, links = plain_alignment(text, libraries)
        pairs = Counter({((x >> 17) & 131071, x & 131071): x >> 34 for x in row.links.tolist()})
        assert (row.n_a, row.n_b, row.n_groups, row.groups, pairs) == (n_a, n_b, len(groups), written(groups), Counter(links)), text
        seen += n_a > 0
    assert seen > 400


def test_alignment_report(spark, libraries):
    rnd = random.Random(2)
    texts = odd_texts(60, 5) + ["same text here"] * 5
    ids = [None if rnd.random() < 0.05 else rnd.randrange(500) for _ in texts]
    docs = spark.createDataFrame([(t, i, "d", 1, False) for t, i in zip(texts, ids)], SCHEMA).repartition(3)
    found = [(i, plain_alignment(t, libraries)) for t, i in zip(texts, ids)]
    count = Counter(x for _, (_, _, _, links) in found for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = [(i, a, b, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), sha(written(g)) if a else "") for i, (a, b, g, x) in found]
    got = token_align.alignment_report(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    pairs = token_align.pair_counts(token_align.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))).collect()
    assert {(r["a_id"], r["b_id"]): r["count"] for r in pairs} == count and all(r["b_max"] == best[r["b_id"]] for r in pairs)
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    assert all(r["a_max"] == most[r["a_id"]] for r in pairs)
    assert token_align.alignment_report(docs.limit(0), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).collect() == []


WHITE = "\x20\x09-\x0d"


def plain_damage(rows):
    """(conv, turn, role, text) rows left of each conversation."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain_faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        core = re.sub(f"[{WHITE}]+$", "", text)
        fault = "blank" if not re.search(f"[^{WHITE}]", text) else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows, faults):
    """(cost, audit, turns): a forward pass that keeps the best way to each prefix's last initials, whole ways side by side."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    def with_inserts(best):
        for _ in range(4):
            for last, (cost, audit, said) in list(best.items()):
                for role in ("user", "assistant"):
                    if role[0] in allowed[last]:
                        new = (cost + 3, audit + "I", [*said, role + ":"])
                        best[role[0]] = min(best.get(role[0], new), new)
        return best

    best = with_inserts({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def offer(last, way):
            new[last] = min(new.get(last, way), way)

        for last, (cost, audit, said) in best.items():
            offer(last, (cost + 4, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role and role[0] in allowed[last]:
                offer(role[0], (cost + more, audit + "K", [*said, f"{role}:{text}"]))
            for made in ("user", "assistant"):
                if made[0] in allowed[last]:
                    offer(made[0], (cost + more + 3, audit + "R", [*said, f"{made}:{text}"]))
        best = with_inserts(new)
    return min(best[x] for x in ("", "a") if x in best)


def plain_report(conv, rows):
    faults = plain_faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, said = plain_repair(rows, faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(said)))


def test_cheapest_edits_of_all_short_conversations():
    """Against every way of editing, by plain enumeration."""
    import itertools

    lawful = re.compile("(s?(ua)+)?")
    for n in range(4):
        for codes in itertools.product("xsuaoUA", repeat=n):
            best = None
            for edits in itertools.product("DKRr", repeat=n):  # r: rerole to assistant
                steps, cost = [], 0
                for code, e in zip(codes, edits):
                    if code == "x" and e != "D":
                        break
                    cost += {"D": 4, "K": 0, "R": 3, "r": 3}[e] + (3 if code.isupper() and e != "D" else 0)
                    steps.append((e, {"D": "", "K": code.lower(), "R": "u", "r": "a"}[e]))
                else:
                    for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=n + 1):
                        if cost + 3 * sum(map(len, gaps)) > 4 * n:
                            continue
                        if lawful.fullmatch(gaps[0] + "".join(x + g for (_, x), g in zip(steps, gaps[1:]))):
                            audit = "I" * len(gaps[0]) + "".join(e.upper() + "I" * len(g) for (e, _), g in zip(steps, gaps[1:]))
                            way = (cost + 3 * sum(map(len, gaps)), audit)
                            best = way if best is None else min(best, way)
            assert conversation_repair.solve("".join(codes)) == best, codes


ROLES = ["user", "assistant", "system", "tool", "", None, "unknown", "\u00fcser"]
SAID = ["Yes.", "No!", "cut off", " \t", "", None, "Really? ", "a\u3000", "end.\n", "q?\x1f", "Yes."]


def odd_conversations(n=150, seed=4):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        size = rnd.choice([1, 1, 2, 3, 5, 8, 13])
        start = rnd.randint(-3, 2)
        for t in range(start, start + size):
            role = rnd.choice(ROLES) if rnd.random() < 0.3 else ("user", "assistant")[(t - start) % 2]
            rows.append((c if c else None, None if rnd.random() < 0.1 else t + (rnd.random() < 0.1), role, rnd.choice(SAID)))
    rows += [(9_000, t, "user" if t % 2 else "assistant", f"turn {t % 700}.") for t in range(3_000)]
    rows += [(9_001, 0, "user", "long. " * 100_000), (9_001, 1, "assistant", "ok.")]
    dropped = [i for i in range(10_000, 12_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    rows += [(i, 0, "user", "gone.") for i in dropped]
    rnd.shuffle(rows)
    return rows


def test_conversation_repair(spark):
    rows = odd_conversations()
    turns = spark.createDataFrame([(t, r, x, c, True, 3) for c, t, r, x in rows], "turn long, role string, text string, conv_id long, lost boolean, fault int").repartition(5)
    got = conversation_repair.repair_report(conversation_repair.damage(turns), lost_col="lost").collect()
    want = {c: plain_report(c, r) for c, r in plain_damage(rows).items()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r) == want[r["conv_id"]]
    assert sum(not r["audit"] for r in got) >= 3
    # Without damage, by the operator itself: what it gives is lawful and keeps whole texts.
    plain = conversation_repair.repair(turns.drop("lost")).collect()
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in r["roles"])) for r in plain)
    assert next(r for r in plain if r["conv_id"] == 9_001)["texts"] == ["long. " * 100_000, "ok."]
    assert conversation_repair.repair(turns.limit(0).drop("lost")).collect() == []
