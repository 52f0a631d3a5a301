"""Line tables of the five dialects, their shared functions, class rules and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge import dialects
from tidegauge.functions import text as T
from tidegauge.operators import detect
from tidegauge.operators.classes import DEFAULT, load

SCHEMA = "file_idx int, line_block long, line_no long, value string"


def lines(spark, *values, file_idx=0):
    return spark.createDataFrame([(file_idx, 0, i, v) for i, v in enumerate(values)], SCHEMA)


def parsed(spark, dialect, *values, **kw):
    return dialects.parse(lines(spark, *values), dialect, **kw).orderBy("line_no").collect()


def one(spark, dialect, value, **kw):
    return parsed(spark, dialect, value, **kw)[0]


HA = '198.51.100.9:5000 [02/Mar/2026:10:00:00.250] web~ app/s1 0/2/1/37/40 200 512 - - ---- 3/3/0/0/0 0/0 {shop.example.test:8443|Agent x|203.0.113.7} "GET /a?b=1 HTTP/1.1"'


def test_haproxy(spark):
    sys = "Mar  2 10:00:00 front-b haproxy[73190]: "
    rows = parsed(spark, "haproxy", HA, sys + HA, HA.replace("0/2/1/37/40", "0/-1/-1/-1/40"), HA.replace("----", "sD--").replace(" 200 ", " 504 "), '1.2.3.4:5 [02/Mar/2026:10:00:00.250] web web/<NOSRV> -1/-1/-1/-1/5 400 187 - - PR-- 3/3/0/0/0 0/0 "<BADREQ>"', "", None, "[ALERT] 061/100000 (1) : no server", HA.split(" web~")[0] + " web~ app/s1", HA.replace(" 200 512", " x 512"), HA.replace("02/Mar", "99/Mar"), HA.replace('"GET /a?b=1 HTTP/1.1"', '"a"b" c"'))
    assert [r.parse_status for r in rows] == ["parsed"] * 5 + ["skipped"] * 3 + ["malformed", "malformed", "skipped", "parsed"]
    r = rows[0]
    assert (r.ts, r.method, r.path, r.query, r.host, r.status, r.bytes) == (datetime(2026, 3, 2, 10, 0, 0, 250000), "GET", "/a", "b=1", "shop.example.test:8443", 200, 512)
    assert (r.frontend, r.backend, r.server, r.wait_ns, r.response_ns, r.total_ns, r.term_state, r.client_identity) == ("web~", "app", "s1", 2_000_000, 37_000_000, 40_000_000, None, True)
    assert rows[1][5:] == r[5:]
    assert (rows[2].wait_ns, rows[2].response_ns, rows[2].total_ns) == (None, None, 40_000_000)
    assert rows[3].term_state == "sD--" and (rows[4].method, rows[4].path, rows[4].status, rows[4].server) == (None, "<BADREQ>", 400, "<NOSRV>")
    assert rows[11].path == "c"


def test_haproxy_zone_and_identity(spark):
    assert one(spark, "haproxy", HA, tz="Europe/Rome").ts == datetime(2026, 3, 2, 9, 0, 0, 250000)
    anonymous = HA.replace("198.51.100.9:5000 ", "- ")
    assert not one(spark, "haproxy", anonymous).client_identity
    assert one(spark, "haproxy", anonymous, xff_capture=3).client_identity
    assert not one(spark, "haproxy", anonymous.replace("203.0.113.7", "-"), xff_capture=3).client_identity


NG = '198.51.100.9 - bob x [02/Mar/2026:10:00:00 +0100] "GET /a.js?v=2 HTTP/1.1" 200 512 "-" "agent (x) 1.5" MISS 0.042'


def test_nginx(spark):
    rows = parsed(spark, "nginx", NG, NG.replace(" MISS 0.042", ""), NG.replace('MISS 0.042', '"hit" -'), NG.replace("198.51.100.9", "-"), "", "# comment", "2026/03/02 10:00:00 [error] 1#1: *1 open() failed, client: 1.2.3.4 x", NG.replace(" 200 512", " 2x0 512"), NG.replace('"GET /a.js?v=2 HTTP/1.1"', '"" '), NG.replace("MISS 0.042", "1e-3 stale 7"))
    assert [r.parse_status for r in rows] == ["parsed"] * 4 + ["skipped"] * 3 + ["malformed"] * 2 + ["parsed"]
    r = rows[0]
    assert (r.ts, r.path, r.query, r.status, r.bytes, r.cache, r.total_ns, r.client_identity) == (datetime(2026, 3, 2, 9), "/a.js", "v=2", 200, 512, "MISS", 42_000_000, True)
    assert (rows[1].cache, rows[1].total_ns) == (None, None) and (rows[2].cache, rows[2].total_ns) == ("HIT", None)
    assert not rows[3].client_identity and (rows[9].cache, rows[9].total_ns) == ("STALE", 1_000_000)


TR = {"StartUTC": "2026-03-02T10:00:00.123456789Z", "RequestMethod": "GET", "RequestPath": "/a?b=1", "RequestHost": "Shop.example.test", "DownstreamStatus": 200, "OriginStatus": 201, "DownstreamContentSize": 9, "Duration": 5e6, "OriginDuration": 4000000, "ServiceName": "svc", "RouterName": "rt", "ClientHost": "-", "request_Cache-Status": "hit", "Extra": {"a": 1}}


def test_traefik(spark):
    v = lambda **kw: json.dumps({k: x for k, x in (TR | kw).items() if x is not ...})
    rows = parsed(spark, "traefik", v(), v(DownstreamStatus=0, Duration=0), v(StartUTC="", StartLocal="2026-03-02T11:00:00+01:00"), '{"level":"info","msg":"up"}', "time=now", "", v()[:-4], v(DownstreamStatus="200"), v(StartUTC="yesterday"), v(RequestPath=""), v(DownstreamStatus=200.5), v(ClientHost=...))
    assert [r.parse_status for r in rows] == ["parsed"] * 3 + ["skipped"] * 3 + ["malformed"] * 5 + ["parsed"]
    r = rows[0]
    assert (r.ts, r.path, r.query, r.host, r.status, r.bytes, r.total_ns, r.response_ns, r.frontend, r.backend, r.cache, r.client_identity) == (datetime(2026, 3, 2, 10, 0, 0, 123456), "/a", "b=1", "shop.example.test", 200, 9, 5_000_000, 4_000_000, "rt", "svc", "HIT", True)
    assert (rows[1].status, rows[1].total_ns) == (201, None) and rows[2].ts == datetime(2026, 3, 2, 10) and not rows[11].client_identity


def test_a_json_line_is_one_object_and_no_more(spark):
    v = json.dumps(TR)
    more = lambda tail: f"{v[:-1]}, {tail}}}"
    bad = [v + " x", v + "]", v + "}", f"{v},{v}", v + ',{"":1}] x', v + v, v[:-1] + ",}", v.replace('"', "'"), more('"x":NaN'), more('"x":01'), more('"x":"a\tb"'), more("x:1"), more('"RequestPath":7'), more('"requestpath":["/b"]')]
    bad += [more('"DownstreamStatus":200.0'), more('"DownstreamStatus":2e2'), more('"DownstreamContentSize":9223372036854775808'), more('"duration":"5"'), more('"RequestHost":false,"RequestHost":"h"')]
    good = ["\ufeff" + v, v + " \t", more('"REQUESTPATH":"/up"'), more('"RequestPath":"/one","requestPath":"/two"'), more('"RequestPath":null'), more('"requestho\u017ft":"LONG.example.test"'), more('"downstream\u017ftatus":418'), more('"x":{"DownstreamStatus":[1,"]}"]}'), more('"":1,"\\u0052equestPath":"/esc"')]
    rows = parsed(spark, "traefik", *bad, *good, v[1:])
    assert [r.parse_status for r in rows] == ["malformed"] * len(bad) + ["skipped"] + ["parsed"] * 8 + ["skipped"]
    ok = rows[len(bad) + 1 : -1]
    assert [r.path for r in ok] == ["/a", "/up", "/two", "/a", "/a", "/a", "/a", "/esc"]
    assert ok[4].host == "long.example.test" and [r.status for r in ok] == [200] * 5 + [418, 200, 200]


def test_repeated_scalars_count_by_the_last_that_says_something(spark):
    more = lambda tail: f"{json.dumps(AK)[:-1]}, {tail}}}"
    rows = parsed(spark, "akamai", more('"statusCode":404'), more('"STATUSCODE":"-","statuscode":" ","statusCode":null'), more('"statusCode":{"a":1}'), more('"cacheStatus":[0]'), more('"reqPath":5'), more('"reqHost":""'))
    assert [r.parse_status for r in rows] == ["parsed", "parsed", "malformed", "parsed", "malformed", "parsed"]
    assert [rows[i].status for i in (0, 1, 3)] == [404, 200, 200] and rows[3].cache is None and rows[5].host is None


CF = "#Fields: date time x-edge-location sc-bytes c-ip cs-method cs(Host) cs-uri-stem sc-status cs-uri-query x-edge-result-type x-host-header time-taken time-to-first-byte"
ROW = "2026-03-02\t10:00:00\tFRA2\t512\t198.51.100.9\tGET\tD.cdn.test\t/a\t200\tb=1\tHit\tShop.example.test\t0.045\t0.040"


def test_cloudfront(spark):
    dashes = "2026-03-02\t10:00:01\t-\t-\t-\tGET\tD.cdn.test\t/q?x=1\t000\t-\t-\t-\t-\t-"
    turned = "#Fields: sc-status time date cs-uri-stem time-taken"
    rows = parsed(spark, "cloudfront", ROW, "#Version: 1.0", CF, ROW, dashes, "", ROW.replace("2026-03-02", "-"), ROW.replace("/a", "-"), ROW.replace("\t200\t", "\tx\t"), turned, "204\t10:00:09\t2026-03-02\t/z\t1.5", "204\t10:00:09")
    assert [r.parse_status for r in rows] == ["malformed", "skipped", "skipped", "parsed", "parsed", "skipped", "malformed", "malformed", "malformed", "skipped", "parsed", "malformed"]
    r = rows[3]
    assert (r.ts, r.path, r.query, r.status, r.bytes, r.host, r.cache, r.frontend, r.total_ns, r.response_ns, r.client_identity) == (datetime(2026, 3, 2, 10), "/a", "b=1", 200, 512, "shop.example.test", "HIT", "FRA2", 45_000_000, 40_000_000, True)
    d = rows[4]
    assert (d.path, d.query, d.status, d.host, d.total_ns, d.cache, d.client_identity) == ("/q", "x=1", 0, "d.cdn.test", None, None, False)
    assert (rows[10].status, rows[10].path, rows[10].total_ns, rows[10].response_ns) == (204, "/z", 1_500_000_000, None)
    two = lines(spark, CF, ROW).union(lines(spark, ROW, file_idx=1))
    assert [r.parse_status for r in dialects.parse(two, "cloudfront").orderBy("file_idx", "line_no").collect()] == ["skipped", "parsed", "malformed"]


AK = {"reqTimeSec": "1772445600.123", "reqMethod": "GET", "reqPath": "/a", "reqHost": "Shop.example.test", "queryStr": "b=1", "statusCode": "200", "cacheStatus": "1", "turnAroundTimeMSec": "41", "totalBytes": "512", "cliIP": "198.51.100.9", "xForwardedFor": "-"}


def test_akamai(spark):
    v = lambda **kw: json.dumps({k: x for k, x in (AK | kw).items() if x is not ...})
    numbers = '{"reqTimeSec":1772445600.123,"reqMethod":"GET","reqPath":"/a?q=2","statusCode":200,"cacheStatus":0,"turnAroundTimeMSec":41.5,"totalBytes":512.0}'
    rows = parsed(spark, "akamai", v(), numbers, v(cacheStatus=...), v(statusCode=...), "", "text", json.dumps(TR), '{"version":1}', v()[:-3], v(reqTimeSec="-"), v(reqTimeSec="soon"), v(statusCode="ok"), v(reqPath=""), v(cliIP="-"))
    assert [r.parse_status for r in rows] == ["parsed"] * 4 + ["skipped"] * 4 + ["malformed"] * 5 + ["parsed"]
    r = rows[0]
    assert (r.ts, r.path, r.query, r.host, r.status, r.bytes, r.cache, r.response_ns, r.total_ns, r.client_identity) == (datetime(2026, 3, 2, 10, 0, 0, 123000), "/a", "b=1", "shop.example.test", 200, 512, "HIT", 41_000_000, None, True)
    assert (rows[1].ts, rows[1].path, rows[1].query, rows[1].cache, rows[1].response_ns, rows[1].bytes) == (r.ts, "/a", "q=2", "MISS", 41_500_000, 512)
    assert rows[2].cache is None and rows[3].status == 0 and not rows[13].client_identity


def test_detection(spark):
    samples = {"haproxy": [HA] * 3, "nginx": [NG] * 3, "traefik": [json.dumps(TR)] * 3, "cloudfront": [CF, ROW, ROW], "akamai": [json.dumps(AK)] * 3}
    for name, s in samples.items():
        assert detect.detect(lines(spark, *s)) == name
    with pytest.raises(detect.DetectionError):
        detect.detect(lines(spark, "nothing", "here"))
    with pytest.raises(detect.DetectionError):
        detect.winner({"a": 2, "b": 2})
    with pytest.raises(ValueError):
        dialects.by_name("apache")
    assert dialects.is_cdn("Akamai") and not dialects.is_cdn("nginx")


def test_text_functions(spark):
    df = spark.createDataFrame([('a  "b c" [d e]x{f g} "open',)], "s string")
    assert df.select(T.tokens(F.col("s"))).first()[0] == ["a", '"b c"', "[d e]", "x", "{f g}", '"open']
    hosts = ["a.test", "a.test:80", "A-b_c.d", "-", "", "localhost", "a b.test", "a/b.test", "x@y.test"]
    assert [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string").orderBy("i").select(T.is_host(F.col("h"))).collect()] == [True] * 3 + [False] * 6
    nums = ["12", "-3", "+4", " 12", "5d", "1e3", "inf", "0x1", "", "1.5", "99999999999999999999"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(nums)], "i int, n string").orderBy("i").select(T.integer(F.col("n")), T.number(F.col("n"))).collect()
    assert [r[0] for r in got] == [12, -3, 4] + [None] * 8
    assert [r[1] for r in got] == [12.0, -3.0, 4.0, None, None, 1000.0, None, None, None, 1.5, 1e20]
    codes = spark.createDataFrame([(0,), (100,), (204,), (599,), (600,)], "c int").select(T.status_class(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["other", "1xx", "2xx", "5xx", "other"]
    paths = ["/reset/a1b2c3d4e5f6a7b8c9d0e1", "/news/48211", "/a-long-slug-with-many-words-2026", "/abcdefghijklmnopqrstuvwxyz", "/12345678901234567890"]
    assert [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(T.looks_secret(F.col("p"))).collect()] == [True, False, False, False, True]
    assert T.round1(52.45) == 52.5 or T.round1(52.45) == 52.4


def test_classes(spark):
    cases = [("/a", "_rsc=1", "rsc_nav"), ("/a", "x=1;_rsc", "rsc_nav"), ("/a", "_rscx=1", "doc"), ("/v/1.TS", "", "media"), ("/x.JS", "", "static"), ("/en/search", "", "search"), ("/cerca/x", "", "search"), ("/api/x", "", "api"), ("/graphql", "", "api"), ("/apix", "", "doc"), ("/", "", "doc")]
    df = spark.createDataFrame([(i, p, q, "GET") for i, (p, q, _) in enumerate(cases)], "i int, path string, query string, method string").orderBy("i")
    assert [r[0] for r in df.select(DEFAULT.column()).collect()] == [c for _, _, c in cases]
    own = load(json.dumps({"fallback": "rest", "rules": [{"name": "w", "methods": ["post"], "path_prefixes": ["/A"], "kind": "rsc", "label": "W"}]}))
    assert own.names() == ["w", "rest"] and own.kind("w") == "rsc" and own.kind("rest") == "plain" and own.label("rest") == "rest"
    got = spark.createDataFrame([("/a1", "", "POST"), ("/a1", "", "GET")], "path string, query string, method string").select(own.column()).collect()
    assert [r[0] for r in got] == ["w", "rest"]
    ok = {"name": "a", "path_prefixes": ["/"]}
    for bad in ({"rules": [ok]}, {"fallback": "f", "rules": [{"path_prefixes": ["/"]}]}, {"fallback": "f", "rules": [ok, ok]}, {"fallback": "a", "rules": [ok]}, {"fallback": "f", "rules": [ok | {"kind": "x"}]}, {"fallback": "f", "rules": [{"name": "a", "methods": ["GET"]}]}):
        with pytest.raises(ValueError):
            load(json.dumps(bad))


def test_stream_counts_each_second_once(spark, tmp_path):
    from tidegauge.streaming import per_second_stream, read_stream

    (tmp_path / "in").mkdir()
    late = HA.replace("10:00:00.250", "10:30:00.000")
    (tmp_path / "in/a.log").write_text("\n".join([HA, HA, HA.replace("/a?b=1", "/x.js"), late]) + "\n")
    q = per_second_stream(read_stream(spark, str(tmp_path / "in"), "haproxy"), late="1 minute").writeStream.format("memory").queryName("persec").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.cls, r.n) for r in spark.table("persec").collect()}
    assert got == {("doc", 2), ("static", 1)}
