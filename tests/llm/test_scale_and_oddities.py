"""Split groups, keyed reads, hostile pages and bounded fits, against plain versions."""

import base64
import hashlib
import html
import random
import time
import tracemalloc
import uuid
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_search_and_dedup import brute_components, brute_hits, frame, tokenizer
from tidegauge.llm import fm_index, jaccard_join, ordinal, source_mix, token_store, warc


def family(n=220, words=60, changed=6, seed=11):
    """Near copies of one text, none of which is near to all others, with loners and odd rows."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rnd.sample(range(words), rnd.randint(0, changed) // 2):
            w[at] = f"x{rnd.randrange(4)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(rnd.choices(base, k=40))) for i in range(30)]


def test_crowded_group_is_split_and_read_in_rounds(spark):
    rows = family()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), crowded=16, nearest=1).collect()}
    assert got == brute_components(rows)


def test_open_keys_are_compared_once(spark, monkeypatch):
    """One key for a set of members, a member once however many tasks sent it, and only keys that held pairs back again."""
    rows = family(60)
    for i in range(20):  # a little less than similar, which only whole sets tell
        w = [f"y{j}" for j in range(250)]
        for at in (2, 240, 10 + 10 * i, 15 + 10 * i):
            w[at] = f"z{i}_{at}"
        rows.append((500 + i, " ".join(w)))
    seen, held, compare = [], [], jaccard_join._compare_open

    def watched(now_open, *args):
        seen.append([(r.k, tuple(sorted(r.m))) for r in now_open.groupBy("k").agg(F.collect_list("cls").alias("m")).collect()])
        out = compare(now_open, *args)
        held.append({r.a for r in out.where("b is null").collect()})
        return out

    monkeypatch.setattr(jaccard_join, "_compare_open", watched)
    dealt = frame(spark, rows + [(1000 + d, t) for d, t in rows] + [(2000 + d, t) for d, t in rows]).repartition(12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(dealt, crowded=16, nearest=1).collect()}
    assert {d % 1000: v for d, v in got.items()} == brute_components(rows) and len(got) == 3 * len(rows)
    assert len(seen) > 1 and all(len(set(m)) == len(m) for found in seen for _, m in found)
    assert all(len({m for _, m in found}) == len(found) for found in seen)
    assert all({k for k, _ in later} <= back for back, later in zip(held, seen[1:]))


def test_components_of_null_and_repeated_ids(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(None, text + " z"), (None, text + " z"), (1, text), (1, text), (1, "other words of their own here"), (2, text + " y"), (None, "other words of their own here now")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect())
    assert [g[2] for g in got if g[1] > 50] == [1] * 5 and len(got) == len(rows)


def test_a_pair_of_many_keys_is_compared_once(spark):
    """Two components that share all their keys give one candidate, not one a key."""
    import pyarrow as pa

    n = 40
    sketch = jaccard_join.dense_sketch(np.arange(n, dtype=np.uint64)).tobytes()
    rows = [(k, 0, 0, 0, c, c, n, [0, 1, 2, 3], sketch, None) for k in range(30) for c in (5, 9)]
    names = ("k", "i", "j", "own", "cls", "comp", "n", "low", "sketch", "tested")
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if x in ("low", "tested") else pa.binary() if x == "sketch" else pa.int64()) for x, c in zip(names, zip(*rows))], names=list(names))
    out = [r for b in jaccard_join._open_pairs(iter([batch]), 80, 8) for r in b.to_pylist()]
    assert out == [{"a": 5, "b": 9}]


def test_token_store_shards_and_keyed_reads(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    tok.encode_special_tokens = True
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta", "gamma,", "de-lta"], k=rnd.randint(0, 9)))) for i in range(300)] + [(7, f"again {i}") for i in range(60)] + [(None, f"none {i}") for i in range(60)] + [(8, "same")] * 50
    path = str(tmp_path / "store")
    got = sorted(map(tuple, token_store.store_documents(frame(spark, rows), tokenizer(), path, shard_ids=40).collect()), key=lambda r: r[1])
    want, start, ids = [], 0, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        x = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
        ids.setdefault(d, []).extend(x)
    assert got == want
    store = token_store.read_store(spark, path)
    assert store.count() > 40
    asked = [3, 7, 8, 150, 299, 5000, None]
    keys = spark.createDataFrame([(k,) for k in asked], "key long")
    for block in (token_store.BROADCAST_ROWS, 10):
        found = {r.key: r.ids for r in token_store.lookup(spark, path, keys, block=block).collect()}
        assert found == {k: ids.get(k) for k in asked}
    one = store.where(store.shard == store.agg({"shard": "max"}).first()[0])
    one.collect()
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() == 1  # a row group of one shard, out of them all
    assert token_store._ranges(np.array([1, 2, 3, 9, 10, 40]), 2) == [(1, 10), (40, 40)] and token_store._ranges(np.array([4])) == [(4, 4)]


def test_a_thousand_spread_keys_read_a_thousand_shards(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(frame(spark, [(i, f"text {i}") for i in range(3000)]), path, tokenizer(), shard_ids=1)
    store = token_store.read_store(spark, path)
    names = np.array(sorted(r.shard for r in store.select("shard").collect()), np.int64)
    assert len(names) == 3000
    near = token_store.shards_at(store, names, np.arange(0, 3000, 3))
    assert near.count() == 1000
    near.collect()
    leaves = near._jdf.queryExecution().executedPlan().collectLeaves()
    assert sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())) == 1000
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "key")
    assert {r.key for r in token_store.lookup(spark, path, keys).collect() if r.ids} == set(range(0, 3000, 3))


def test_suffix_array_of_repeats():
    rnd = np.random.default_rng(2)
    for text in (np.r_[np.tile([3, 4, 5], 40), 0], np.r_[rnd.integers(2, 4, 200), 1, rnd.integers(2, 4, 200), 0], np.array([0])):
        order = fm_index.suffix_array(text.astype(np.int64))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("block", [fm_index.BLOCK_CHARS, 10])
def test_fm_rows_of_one_id_keep_their_own_hits(spark, block):
    items = [(1, "alpha beta gamma"), (2, "delta eps zeta")]
    texts = ["alpha beta gamma x y z", "q r s delta eps zeta", None, "", "alpha beta gamma x y z"]
    docs = frame(spark, [(None if i == 4 else 1, t) for i, t in enumerate(texts)])
    got = fm_index.digest(fm_index.occurrences(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=block)).collect()
    want = [brute_hits([(0, t)], items)[0] for t in texts]
    assert sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)


class Plain(HTMLParser):
    """Title, links and visible lines of well-formed pages by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.links, self.hidden, self.link, self.title, self.in_title = [""], [], 0, None, "", False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "svg"):
            self.hidden += 1
        if tag in warc._BLOCKS:
            self.lines.append("")
        self.in_title |= tag == "title"
        if tag == "a" and dict(attrs).get("href") is not None:
            self.link = [dict(attrs)["href"].strip(), ""]

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template", "svg"):
            self.hidden -= 1
        if tag in warc._BLOCKS:
            self.lines.append("")
        self.in_title &= tag != "title"
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join(self.link[1].split())))
            self.link = None

    def handle_data(self, data):
        if not self.hidden:
            self.lines[-1] += data
            self.title += data if self.in_title else ""
            if self.link:
                self.link[1] += data


def test_pages_match_the_standard_parser(spark, small):
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert len(pages) > 20
    for page in pages:
        p, got = Plain(), warc.Page(page or "")
        p.feed(page or "")
        p.close()
        assert got.text == "\n".join(x for x in (" ".join(y.split()) for y in p.lines) if x)
        assert (got.title or "") == " ".join(p.title.split()) and got.links == p.links


@pytest.mark.parametrize("opener", ["<a ", "<title>", "<script ", "<script>", "<!--", "<a href='", "<title", "</a", "<", "&", "&#", "&#9", "&#x", "&#0"])
def test_hostile_pages_take_linear_time(opener):
    page = opener * (1_000_000 // len(opener))
    began = time.process_time()
    made = warc.derive(warc.response(1, "http://h.test/", page))
    assert len(made) == 2 and time.process_time() - began < 3


def test_pages_that_no_decoder_likes(spark):
    """A reference of a million digits, zeros before a digit, invalid bytes, every opener: two records a page, by a plain rule."""
    raw = [b"<title>&#" + b"9" * 1_000_000 + b"; t</title><a href='/&#" + b"1" * 5_000 + b"'>x&#" + b"0" * 5_000 + b"65;</a>", b"a\xff\xfe<b>\xc3</b>", b"<a href='http://[1/'>bad host</a>", *(o.encode() * 5_000 for o in ("<a ", "<title>", "<!--", "</a", "<", "&#9"))]
    pages = spark.createDataFrame([(i, f"http://h.test/{i}", bytearray(x)) for i, x in enumerate(raw)], "page_id long, url string, html binary")
    for rows in (pages, pages.withColumn("html", F.col("html").cast("string"))):
        got = {(r.page_id, r.record_type): r for r in warc.derivatives(rows).collect()}
        assert len(got) == 2 * len(raw)
        for i, page in enumerate(raw):
            body = page.decode("utf-8", "replace").encode()
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
            digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
            of = uuid.uuid5(warc.SPACE, f"response\n{i}\nhttp://h.test/{i}")
            for kind in ("metadata", "conversion"):
                r = got[i, kind]
                assert r.refers_to == f"<urn:uuid:{of}>" and r.record_id == f"<urn:uuid:{uuid.uuid5(warc.SPACE, kind + chr(10) + r.refers_to)}>"
            said = got[i, "conversion"].headers
            assert said["WARC-Source-Payload-Digest"] == digest(body) and said["WARC-Source-Block-Digest"] == digest(block)
        block = next(warc.parse(bytes(got[0, "metadata"].record)))["block"].decode()
        assert "title: \ufffd t\r\n" in block and "outlink: http://h.test/\ufffd xA\r\n" in block


def test_warc_files_as_a_source(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h.test/{i}", f"<title>t{i}</title><a href=/x>go</a> text {i}") for i in range(6)] + [(9, None, None)], "page_id long, url string, html string")
    whole = warc.derivatives(pages, responses=True).orderBy("page_id").collect()
    for name, compressed in (("a.warc.gz", True), ("b.warc", False)):
        records = [next(warc.parse(bytes(r.record))) for r in whole]
        (tmp_path / name).write_bytes(b"".join(warc.to_bytes(r, compressed) for r in records))
    read = warc.read_warc(spark, str(tmp_path / "*.warc*"))
    assert read.count() == 2 * len(whole)
    key = lambda r: (r.record_id, r.record_type, bytes(r.record))
    want = sorted(key(r) for r in whole if r.record_type != "response")
    assert sorted(key(r) for r in warc.derive_records(read).collect()) == sorted(want * 2)
    assert html.unescape("&lt;") == "<"


def test_bounded_fit_meets_all_margins():
    rnd = np.random.default_rng(6)
    codes = [x.ravel() for x in np.indices((4, 3, 5))]
    tokens = rnd.integers(1, 1000, 60).astype(float) * np.where(rnd.random(60) < 0.2, 0.01, 1)
    shares = [np.bincount(c, tokens / tokens.sum()) for c in codes]
    goals = [s**0.5 / (s**0.5).sum() for s in shares]
    plan = source_mix.plan_cells(tokens, codes, goals, 0.9)
    drawn = tokens * plan.p
    assert (plan.p > 1 - 1e-9).any() and plan.p.max() <= 1 and np.isclose(drawn.sum(), 0.9 * tokens.sum())
    for c, t in zip(codes, plan.targets):
        assert np.abs(np.bincount(c, drawn / drawn.sum()) - t).max() < 1e-6
    assert np.allclose(source_mix.within(np.array([0.7, 0.2, 0.1]), np.array([0.4, 0.5, 0.9])), [0.4, 0.4, 0.2])
    alone = source_mix.plan_cells(np.array([90.0, 10]), [np.array([0, 1]), np.array([0, 1])], [np.array([0.5, 0.5]), np.array([0.6, 0.4])], 0.1)
    assert alone.blend > 0 and np.abs(alone.p * [90, 10] / 10 - alone.targets[0]).max() < 1e-6  # margins that contradict each other move


def test_topics_are_those_of_a_plain_pass(spark):
    rnd = random.Random(2)
    texts = ["word " * rnd.randint(1, 50) for _ in range(30)] + ["12 | 34 | 56\n" * rnd.randint(1, 9) for _ in range(30)] + ["LOUD! TEXT?" * rnd.randint(1, 9) for _ in range(30)] + ["", None, "long " * 200_000]
    docs = spark.createDataFrame([(i, "s", "en", t) for i, t in enumerate(texts)], "doc_id long, source string, lang string, text string")
    got = sorted(source_mix.mixed_report(docs).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in got] == [len((t or "").split()) for t in texts]
    kinds = [{r.topic for r in got[i : i + 30]} for i in (0, 30, 60)]
    assert not (kinds[0] & kinds[1]) and not (kinds[1] & kinds[2])


def test_ordinal_scores_match_plain_sums(spark):
    rnd = random.Random(4)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choices(good if i % 2 else bad, k=20))) for i in range(200)] + [(900, None), (901, "x " * 100_000), (3, "again good1")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, int(i % 10 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = ordinal.fit(*ordinal.rated_sample(docs, labels))
    got = ordinal.score_documents(docs, labels).collect()
    cache = ordinal.BucketCache(ordinal.BUCKETS)
    want = []
    for d, t in rows:
        z = sum(model.weights[b] for b in ordinal.features(t.encode() if t is not None else None, cache).tolist())
        tails = [1 / (1 + np.exp(-(z - c))) for c in model.thresholds]
        want.append((d, sum(tails), tails[-1], tails[-1] >= ordinal.KEEP_TAIL))
    assert len(got) == len(want)
    for r, w in zip(sorted(got, key=lambda r: (r.doc_id, r.expected_grade)), sorted(want)):
        assert r.doc_id == w[0] and np.isclose(r.expected_grade, w[1]) and np.isclose(r.tail_probability, w[2]) and r.kept == w[3]


def test_equal_items_are_searched_once(spark):
    """Many answers of few words beside a text that repeats them: as plain search, in the memory of one item."""
    items = [(f"q{i:05d}", ("the", "The!", "the the", "yes the")[i % 4]) for i in range(8000)] + [("long", "the " * 12), ("q00000", "no"), (None, "the")]
    blob = fm_index.Items([("null" if n is None else n, t.encode()) for n, t in items])
    assert len(blob.begin) == len({tuple(fm_index.words_of(t.encode())[:10]) for _, t in items})
    texts = ["the " * 20_000, "yes no", "yes the", "", None, "other words"]
    tracemalloc.start()
    n, found = fm_index.shard_hits([None if t is None else t.encode() for t in texts], blob)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000 and n == [20_000, 2, 2, 0, 0, 2]
    want = []
    for i, t in enumerate(texts):
        words, hit, names = fm_index.words_of((t or "").encode()), set(), set()
        at = {w: [k for k in range(len(words) - len(w) + 1) if tuple(words[k : k + len(w)]) == w] for w in {tuple(fm_index.words_of(x.encode())[:10]) for _, x in items}}
        for name, x in items:
            w = tuple(fm_index.words_of(x.encode())[:10])
            names |= {"null" if name is None else name} if at[w] else set()
        for w, places in at.items():
            hit.update(k + j for k in places for j in range(len(w)))
        want.append((i, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fm_index.digest(fm_index.occurrences(docs, spark.createDataFrame(items, "item_id string, text string"))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got] == want
    assert [list(range(*x.indices(3))) for x in fm_index._portions(found[:3], blob, names=1)] == [[0], [1], [2]]
