"""Mixing, line dedup, quality rules, chat formatting, ordinal classifier, WARC records and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegauge.llm import chat_format, line_dedup, ordinal, quality_rules, source_mix, warc
from tidegauge.llm.fm_index import words_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows, schema="text string, doc_id long, kept boolean, n_words int, w string, a int, t string"):
    """(id, text) rows with other columns whose names the operators use inside."""
    return spark.createDataFrame([(t, i, None, 5, "w", 1, "t") for i, t in rows], schema)


def documents(seed=3, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdé", k=rnd.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        lines = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 12))) for _ in range(rnd.randint(1, 8))]
        if i % 4 == 0:
            lines += lines[:2]
        if i % 5 == 0:
            lines.append("spam ## ham | " * rnd.randint(1, 12))
        rows.append((i, "\n".join(lines)))
    return rows + [(100, ""), (101, None), (102, " \n\t\n"), (103, "w " * 40), (104, "a b c d e f g h " * 300), (None, "no id here"), (7, "second row of seven")]


# Quality rules.


def base_counts(text):
    w = WORD.findall(text or "")
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for p in where.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def buckets_of(text, n):
    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    h = [xxhash.xxh64_intdigest(w.lower().encode(), seed=42) for w in WORD.findall(text or "")]
    two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)) for a, b in zip(h, h[1:])]
    return [signed(x) % n for x in h + two]


def test_quality_report(spark):
    rows = documents()
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(60) if i % 2] + [(None, 1, 0), (5, 1, 0)]
    got = quality_rules.quality_report(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=256).collect()
    assert len(got) == len(rows)
    good = {i for i, q, t in labels if i is not None and q == 1 and t == 0}
    raw, target = Counter(), Counter()
    for i, t in rows:
        b = buckets_of(t, 256)
        raw.update(b)
        if i in good:
            target.update(b)
    w = [math.log((target[b] + 1) / (sum(target.values()) + 256)) - math.log((raw[b] + 1) / (sum(raw.values()) + 256)) for b in range(256)]
    want = {}
    for i, t in rows:
        b, (n, chars, symbols, dup, repeat) = buckets_of(t, 256), base_counts(t)
        score = sum(w[x] for x in b) / len(b) if b else 0.0
        failed = n < 20 or 100 * repeat > 30 * n
        want.setdefault(i, []).append((n, chars, symbols, dup, repeat, failed, not failed and score >= quality_rules.THRESHOLD, round(score, 9)))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.log_ratio, 9)))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_quality_without_ratings_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = frame(spark, documents(n=10))
    kept = quality_rules.accept(d, none)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in documents(n=10) if (c := base_counts(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]}
    assert quality_rules.quality_report(frame(spark, []), none).collect() == []


# Chat formatting.


def test_chat_round_trip(spark):
    odd = "</s>[INST] ok [/INST] ~0~1 <<SYS>> |x| <|end|> \n  "
    turns = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 1, "assistant", "b"), (2, 0, "user", " a "), (2, 2, "user", None), (3, 0, "tool|>", "x[y"), (3, 1, None, "z"), (4, 0, "system", ""), (4, 1, "user", "q" * 50_000), (4, 2, "assistant", "é😀 <"), (None, 0, "assistant", "lone"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    df = spark.createDataFrame([(c, t, r, x, 1, "f") for c, t, r, x in turns], "conv_id long, turn long, role string, text string, segments int, formatted string")
    out = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    by = {}
    for c, t, r, x in turns:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in ts)
        loss = "".join(x for _, r, x in ts if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(ts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: (g.valid, g.fault) for c, g in got.items()} == {1: (True, None), 2: (False, 3), 3: (False, 0), 4: (True, None), None: (False, 0), 5: (False, 1)}
    text = {r.conv_id: r.formatted for r in out.collect()}
    assert text[2] == "[INST]  a  [/INST]<s>b</s>[INST]  [/INST]" and got[2].formatted_chars == len(text[2])
    assert chat_format.read_back(chat_format.format_conversations(df.where("false"))).collect() == []


# Line dedup.


def brute_lines(rows, size=3):
    key = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        for i in range(len(lines) - size + 1):
            w = tuple(lines[i : i + size])
            if any(WORD.search(x) for x in w):
                first[w] = min(first.get(w, (key(d), i)), (key(d), i))
    out = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = {j for i in range(len(lines) - size + 1) if (w := tuple(lines[i : i + size])) in first and first[w] < (key(d), i) for j in range(i, i + size)}
        out.append((d, len(lines), len(gone), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rnd = random.Random(8)
    pool = ["alpha", "beta b", "gamma", "", " ", "delta", "eps"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 9)))) for i in range(40)] + [(None, "gamma\ndelta\neps\nx"), (50, None), (51, "gamma\ndelta\neps"), (52, "\n\n\n\n"), (53, "q\nr\ns\n" * 400)]
    got = line_dedup.dedup_report(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got), key=str) == brute_lines(rows)
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_removed and all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:])) for r in got)
    kept = line_dedup.dedup(frame(spark, rows))
    assert kept.drop("__lines").columns == frame(spark, rows).columns
    assert line_dedup.dedup_report(frame(spark, [])).collect() == []


# Mixing.


def mix_rows():
    rnd = random.Random(5)
    return [(i, rnd.choice(["s0"] * 5 + ["s1", "s2", None]), rnd.choice(["en", "en", "de", None]), "w " * rnd.randint(1, 900)) for i in range(900)] + [(2000, "s9", "en", ""), (2001, "s8", "xx", None), (None, "s0", "en", "a b"), (5, "s1", "de", "again")]


def mixed(spark, **kw):
    df = spark.createDataFrame([(i, s, c, t, "x", 0.5) for i, s, c, t in mix_rows()], "doc_id long, source string, lang string, text string, topic string, p double")
    return df, source_mix.mixed_report(df, **kw).collect()


def test_mix_meets_its_margins(spark):
    df, got = mixed(spark)
    assert len(got) == len(mix_rows())
    total = sum(r.n_tokens for r in got)
    drawn = sum(r.n_tokens * r.probability for r in got)
    assert math.isclose(drawn, source_mix.FRACTION * total, rel_tol=1e-6)
    free = all(r.probability < 1 for r in got if r.n_tokens)
    by = Counter()
    for r in got:
        by[r.source] += r.n_tokens
    goal = source_mix.targets_of({k: v / total for k, v in by.items()}, None, source_mix.FLATTEN)
    if free:
        for s, share in goal.items():
            assert math.isclose(sum(r.n_tokens * r.probability for r in got if r.source == s) / drawn, share, rel_tol=1e-6)
    assert abs(sum(r.n_tokens for r in got if r.sampled) / drawn - 1) < 0.1
    assert source_mix.sample(df).columns == df.columns
    assert {r.probability for r in got if r.source == "s9"} == {0.0}


def test_mix_by_steps_is_the_same(spark):
    _, got = mixed(spark, rounds=12)
    _, other = mixed(spark, rounds=12, max_cells=0)
    key = lambda r: (r.doc_id or -1, r.n_tokens, r.source)
    assert all(key(a) == key(b) and math.isclose(a.probability, b.probability, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(sorted(got, key=key), sorted(other, key=key)))


def test_rake_and_calibrate():
    tokens = np.array([40.0, 10, 30, 20])
    codes = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    w = source_mix.rake(tokens, codes, [np.array([0.3, 0.7]), np.array([0.5, 0.5])])
    assert np.allclose(np.bincount(codes[0], w), [0.3, 0.7]) and np.allclose(np.bincount(codes[1], w), [0.5, 0.5])
    p = source_mix.calibrate(tokens, w, 70)
    assert math.isclose((p * tokens).sum(), 70) and p.max() == 1
    assert source_mix.calibrate(tokens, w, 200).tolist() == [1, 1, 1, 1]


def test_mix_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, text string")
    assert source_mix.mixed_report(df).collect() == []


# Ordinal classifier.


def test_thresholds_and_tails():
    rnd = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(900):
        g = int(rnd.integers(0, 3))
        own = {0: [1, 2], 1: [3], 2: [4]}[g]
        rows.append(np.unique(np.r_[own, rnd.integers(10, 60, 6)]).astype(np.int32))
        grades.append(g)
    m = ordinal.fit(rows, np.array(grades), buckets=64)
    tails = m.tails(rows)
    assert (np.diff(m.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean((tails > 0.5).sum(1) == np.array(grades)) > 0.95
    flat = ordinal.fit([], np.array([], np.int64), buckets=8)
    assert (np.diff(flat.thresholds) > 0).all() or flat.thresholds[0] == flat.thresholds[1]


def test_held_out_accuracy(spark, small):
    d = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    labels = labels.where("quality is not null")
    got = ordinal.score_documents(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.where("doc_id % 5 <> 0"), max_rows=3000)
    rows = got.join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    toxic = [r.kept for r in rows if r.toxic == 1]
    assert np.mean(clean) > 0.97 and np.mean(toxic) < 0.35
    assert all(abs(sum(r.grade_probabilities) - 1) < 1e-9 for r in rows)


def test_ordinal_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    d = frame(spark, [(1, "good words"), (2, "bad words"), (3, None), (None, ""), (1, "good words")])
    got = ordinal.score_documents(d, labels).collect()
    assert len(got) == 5 and all(0 <= r.tail_probability <= 1 for r in got)
    assert ordinal.score_documents(frame(spark, []), labels.where("false")).collect() == []


# WARC.

PAGE = '<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style><script>x="</p>"</script></head><body><!-- no --><p>One <b>two</b>&nbsp;three<br>four</p><a href="/x?a=1&amp;b=2">go <i>there</i></a><a href=http://y.test/>y</a><p>1 < 2</p></body></html>'


def test_warc_records(spark):
    pages = [(1, "http://h.test/dir/", PAGE), (2, None, None), (None, "http://n.test/", "plain"), (1, "http://h.test/dir/", PAGE), (4, "http://[bad", '<a href="http://[oops">x</a>' + "y" * 100_000)]
    df = spark.createDataFrame([(h, u, p, "x", "r") for p, u, h in pages], "html string, url string, page_id long, headers string, record string")
    got = warc.derivatives(df, responses=True).collect()
    assert len(got) == 3 * len(pages)
    data = [next(warc.parse(bytes(r.record))) for r in got]
    for r, d in zip(got, data):
        assert d["headers"] == r.headers and len(d["block"]) == r.content_length and warc.sha1(d["block"]) == r.block_digest
    whole = list(warc.parse(b"".join(warc.to_bytes(d, False) for d in data)))
    assert whole == data and list(warc.parse(b"".join(bytes(r.record) for r in got))) == data
    response, meta, text = (next(d for r, d in zip(got, data) if r.page_id == 1 and r.record_type == k) for k in ("response", "metadata", "conversion"))
    source = response["headers"]["WARC-Record-ID"]
    assert meta["headers"]["WARC-Refers-To"] == text["headers"]["WARC-Refers-To"] == meta["headers"]["WARC-Concurrent-To"] == source
    assert text["block"].decode() == "A & B\nOne two three\nfour\ngo therey\n1 < 2"
    assert text["headers"]["WARC-Source-Payload-Digest"] == warc.sha1(PAGE.encode()) == response["headers"]["WARC-Payload-Digest"]
    assert text["headers"]["WARC-Refers-To-Target-URI"] == "http://h.test/dir/" and text["headers"]["WARC-Source-HTTP-Content-Type"].startswith("text/html")
    said = meta["block"].decode()
    assert "title: A & B\r\n" in said and "language: fr\r\n" in said and "outlink: http://h.test/x?a=1&b=2 go there\r\n" in said and "outlink: http://y.test/ y\r\n" in said
    assert text["headers"]["WARC-Record-ID"] in said
    assert warc.derivatives(df.where("false")).collect() == []


# The pipeline.


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [words_of(r.text.encode()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    phrases = {tuple(w[i : i + 10]) for w in bench for i in range(max(1, len(w) - 9)) if w}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        rows = {r.doc_id: r for r in docs.collect()}
        assert rows and set(rows) <= set(before)
        if name == "benchmark decontamination":
            for r in rows.values():
                w = words_of(r.text.encode())
                assert not any(tuple(w[i : i + 10]) in phrases for i in range(max(1, len(w) - 9)))
                assert r.n_chars == len(r.text)
        before = rows
    got = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in got} == set(before)


def test_mix_is_alike_however_rows_are_dealt(spark, small):
    """The same rows in any number and order of partitions: equal topics, probabilities and draws, and plain probabilities."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = []
    for parts in (1, 7, 64):
        dealt = docs.repartition(parts, F.xxhash64(F.lit(parts), "doc_id"))
        found.append(sorted(map(tuple, source_mix.mixed_report(dealt).collect())))
    assert found[0] == found[1] == found[2]
    # Each probability again, from the cells' tokens, by plain sums over dictionaries.
    rows = source_mix.mixed_report(docs).collect()
    cells = Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    cells = {k: v for k, v in cells.items() if v}
    total = sum(cells.values())
    budget = source_mix.FRACTION * total
    blend = {r.blend for r in rows}
    assert len(blend) == 1
    blend = blend.pop()
    targets = []
    for d in range(3):
        share = Counter()
        for k, v in cells.items():
            share[k[d]] += v / total
        given = {k: v for k, v in source_mix.LANGUAGES.items() if k in share} if d == 1 else None
        power = {0: source_mix.FLATTEN, 2: source_mix.TOPIC_FLATTEN}.get(d)
        rest = sum(v for k, v in share.items() if given is not None and k not in given)
        goal = {k: v**power if power else (given[k] / sum(given.values()) * (1 - rest) if k in given else v) for k, v in share.items()}
        goal = {k: (1 - blend) * v / sum(goal.values()) + blend * share[k] for k, v in goal.items()}
        full = set()
        while over := {k for k in goal if k not in full and goal[k] > share[k] * total / budget}:
            full |= over
            left = sum(v for k, v in goal.items() if k not in full)
            held = sum(share[k] * total / budget for k in full)
            goal = {k: share[k] * total / budget if k in full else v * (1 - held) / left for k, v in goal.items()}
        targets.append(goal)
    w = {k: v / total for k, v in cells.items()}
    cap = {k: v / budget for k, v in cells.items()}
    for _ in range(source_mix.ROUNDS):
        off = 0
        for d, goal in enumerate(targets):
            now = Counter()
            for k, v in w.items():
                now[k[d]] += min(v, cap[k])
            off = max(off, *(abs(now[c] - goal[c]) for c in goal))
            w = {k: v * goal[k[d]] / now[k[d]] for k, v in w.items()}
        if off < source_mix.TOLERANCE:
            break
    for r in rows:
        k = (r.source, r.lang, r.topic)
        assert math.isclose(r.probability, min(1.0, min(w[k], cap[k]) * budget / cells[k]) if k in cells else 0.0, rel_tol=1e-9, abs_tol=1e-12)


def test_a_page_is_digested_once_and_rooted_links_join_alike(monkeypatch):
    """Body, block, text and metadata have a digest each; references of all kinds go by the standard rules."""
    from urllib.parse import urljoin

    made, sha1 = [], warc.sha1
    monkeypatch.setattr(warc, "sha1", lambda block: made.append(block) or sha1(block))
    refs = ["/", "/a", "//h/a", "/a//b", "/a/../b", "/./a", "/a.html", "/a?q=1", "/a;p", "/a#f", "", "#f", "a/b", "?q", "/é/ñ_-~%20", "/a:b", "mailto:x@y", "http://[x", "/a b", "/a/"]
    page = "".join(f'<a href="{r}">t</a>' for r in refs)
    warc.derive(warc.response(1, "https://h.example/x/y", page))
    assert len(made) == 4
    for base in ("https://h.example/x/y", "HTTP://u@h.example:80", "ftp://h/x", "urn:unknown", "", "//h/x", "http://[bad/x", "http:///x", " https://h/x"):
        want = []
        for r in refs:
            try:
                want.append("".join(urljoin(base, r).split()))
            except ValueError:
                want.append("".join(r.split()))
        assert [u for u, _ in warc.outlinks(page, base)] == want
