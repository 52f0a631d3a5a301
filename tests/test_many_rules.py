"""Large class sets: the tables give what the chain of conditions gives."""

import random
import time

import pytest

from tidegauge.access_view import access_events, many_rules
from tidegauge.operators import metrics as M
from tidegauge.operators.classes import CHAIN_TERMS, DEFAULT, ClassSet, Rule
from tidegauge.operators.rule_index import RuleIndex, column

ROWS = "path string, query string, method string"


def _both(spark, classes, rows):
    df = spark.createDataFrame(rows, ROWS)
    return [(r["chain"], r["index"]) for r in df.select(classes.chain().alias("chain"), column(classes).alias("index")).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_tables_equal_the_chain(spark, seed):
    rng = random.Random(seed)
    word = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    terms = lambda n, low: tuple(word("/aB.è", low, 4) for _ in range(rng.randint(0, n)))
    rules = tuple(
        Rule(f"r{i}", path_prefixes=terms(2, 1), path_suffixes=terms(1, 1), path_contains=terms(1, 2), query_params=tuple(word("ab=", 0, 3) for _ in range(rng.randint(0, 1))), methods=rng.choice(((), (), ("GET",), ("post", "Put"), ("",))))
        for i in range(14)
    )
    maybe = lambda x: None if rng.random() < 0.05 else x
    rows = [(maybe(word("/ab.èÈİ", 0, 7)), maybe(word("ab=&;", 0, 8)), maybe(rng.choice(("GET", "get", "POST", "PUT", "")))) for _ in range(600)]
    got = _both(spark, ClassSet(rules, "rest"), rows)
    assert all(a == b for a, b in got) and len({a for a, _ in got}) > 5


def test_the_default_set_and_odd_rows(spark):
    rows = [("/a.JS", "", "GET"), ("/API/x", None, None), (None, "_rsc", "GET"), (None, None, None), ("", "_rscx=1", ""), ("/x/search", "a=1;_rsc=2", "get"), ("/" + "y" * 200_000 + ".ts", "&" * 50_000, "GET")]
    assert _both(spark, DEFAULT, rows) == [(c, c) for c in ("static", "api", "rsc_nav", "doc", "doc", "rsc_nav", "media")]
    assert _both(spark, DEFAULT, []) == []
    empty_terms = ClassSet((Rule("posts", path_contains=("",), methods=("POST",)), Rule("puts", path_prefixes=("",), methods=("PUT",)), Rule("all", path_suffixes=("",))), "rest")
    assert _both(spark, empty_terms, [("/a", "", "POST"), (None, None, "put"), ("", "", None)]) == [("posts", "posts"), ("puts", "puts"), ("all", "all")]


def test_paths_that_are_no_utf8(spark):
    classes = ClassSet((Rule("a", path_prefixes=("/a",)), Rule("z", path_suffixes=("z",))), "rest")
    df = spark.createDataFrame([(b"/b\xff\xfez",), (b"/a\xc3",), (b"\x80",)], "raw binary").selectExpr("cast(raw as string) path", "'' query", "'GET' method")
    got = df.select(classes.chain().alias("chain"), column(classes).alias("index")).collect()
    assert [tuple(r) for r in got] == [("z", "z"), ("a", "a"), ("rest", "rest")]


def test_two_thousand_rules(spark, small):
    """Built within two seconds, and equal to a plain first match on every row."""
    began = time.perf_counter()
    classes = many_rules()
    index = RuleIndex(classes)
    assert time.perf_counter() - began < 2 and len(classes.rules) == 2000 > CHAIN_TERMS
    events = access_events(spark, small)
    got = events.select("path", "query", "method", classes.column().alias("cls")).collect()

    def plain(r):
        path = r["path"].lower()
        for rule in classes.rules:
            hit = any(path.startswith(x.lower()) for x in rule.path_prefixes) or any(path.endswith(x) for x in rule.path_suffixes) or any(x in path for x in rule.path_contains)
            hit = hit or any(part == x or part.startswith(x + "=") for x in rule.query_params for part in r["query"].split("&"))
            if hit and (not rule.methods or r["method"].lower() in [m.lower() for m in rule.methods]):
                return rule.name
        return classes.fallback

    known: dict = {}
    for r in got:
        key = (r["path"], r["query"], r["method"])
        assert r["cls"] == known.setdefault(key, known.get(key) or plain(r))
    assert len({r["cls"][-1] for r in got}) > 4 and len({r["cls"] for r in got}) > 50  # rules of several kinds claim requests
    assert list(index.classify([b"/zzz"], [None], [b"get"])) == ["rest"]


def test_a_report_looks_each_request_up_once(spark, small):
    df = M.cells(M.prepared(access_events(spark, small), many_rules().column()))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_a_path_costs_no_more_with_more_rules(spark):
    """Tables of ten times the rules are looked up as often; only what is found is looked at."""
    took = {}
    paths = [f"/shop/{i}/item-{i * 7}.html".encode() for i in range(4000)]
    for n in (1_000, 10_000):
        index = RuleIndex(ClassSet(tuple(Rule(f"r{i}", path_contains=(f"/part-{i:06d}/",), path_prefixes=(f"/area-{i:06d}/",)) for i in range(n)), "rest"))
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            assert set(index.classify(paths, [None] * len(paths), [b"get"] * len(paths))) == {"rest"}
            runs.append(time.perf_counter() - began)
        took[n] = min(runs)
    assert took[10_000] < 3 * took[1_000]
