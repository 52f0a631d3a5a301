"""Access events over the ``events`` table, and the queries registered on them, each with its SQL.

One hour of the table stands for one second of traffic, so that rates mean something. All derived fields are plain
arithmetic on the table, which the SQL repeats.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge import dialects
from tidegauge.dialects.event import latency_ns
from tidegauge.functions import text as T
from tidegauge.operators import metrics as M
from tidegauge.operators.classes import DEFAULT, ClassSet, Rule
from tidegauge.operators.detect import head_votes, votes
from tidegauge.plans import profile as P
from tidegauge.plans import store as cell_store
from tidegauge.plans.findings import FINDING_SCHEMA, SEVERITY
from tidegauge.plans.report import Counts, Options, build, cells_of, in_window, place
from tidegauge.plans.render import to_json
from tidegauge.sources import read_lines, resolve
from tidegauge.sources.lines import shared_folder
from tidegauge.streaming import with_heads_stream

BASE = 1_767_225_600  # the first logical second, 2026-01-01T00:00:00Z

#: The same view for DuckDB; ``a`` has one row a request.
VIEW_SQL = f"""
WITH raw AS (SELECT event_id AS ord, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
a AS (SELECT ord, {BASE} + hour % 1000000 AS sec,
  (CASE WHEN k % 11 = 0 THEN '/api' ELSE '' END) || '/' || event_type || '/' || (user_id % 40) || (CASE WHEN k % 7 = 0 THEN '.js' ELSE '' END) AS path,
  CASE WHEN k % 5 = 0 THEN '_rsc=' || k ELSE '' END AS query,
  CASE WHEN event_type = 'error' THEN 500 + k % 4 WHEN k % 13 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(floor(value * 20) AS BIGINT) END AS ms,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 4 = 0 THEN 'HIT' WHEN k % 4 = 1 THEN 'MISS' WHEN k % 4 = 2 THEN 'STALE' ELSE 'BYPASS' END AS cache,
  k % 10 <> 0 AS identity, CASE WHEN event_type = 'error' AND k % 4 = 3 THEN 'sD--' END AS term,
  'h' || (user_id % 30) || '.example.test' AS host, k AS bytes FROM raw),
b AS (SELECT *, CASE WHEN query LIKE '\\_rsc=%' ESCAPE '\\' THEN 'rsc_nav' WHEN path LIKE '%.js' THEN 'static' WHEN path LIKE '%/search%' THEN 'search' WHEN path LIKE '/api/%' THEN 'api' ELSE 'doc' END AS cls,
  CASE WHEN status BETWEEN 100 AND 599 THEN (status // 100) || 'xx' ELSE 'other' END AS status_class FROM a),
g AS (SELECT * FROM b UNION ALL SELECT * REPLACE ('(all)' AS cls) FROM b)
"""


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as access events with ``ord``."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ord"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"), "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    k = F.col("k")
    error = F.col("event_type") == "error"
    path = F.concat(F.when(k % 11 == 0, "/api").otherwise(""), F.lit("/"), "event_type", F.lit("/"), (F.col("user_id") % 40).cast("string"), F.when(k % 7 == 0, ".js").otherwise(""))
    null = lambda t: F.lit(None).cast(t)
    return raw.select(
        "ord", F.timestamp_seconds(F.lit(BASE) + F.col("hour") % 1_000_000).alias("ts"), F.lit("GET").alias("method"), path.alias("path"), F.when(k % 5 == 0, F.concat(F.lit("_rsc="), k.cast("string"))).otherwise("").alias("query"),
        F.concat(F.lit("h"), (F.col("user_id") % 30).cast("string"), F.lit(".example.test")).alias("host"), F.when(error, 500 + k % 4).when(k % 13 == 0, 404).otherwise(200).cast("int").alias("status"), k.cast("bigint").alias("bytes"),
        F.lit("web").alias("frontend"), F.lit("app").alias("backend"), F.lit("s1").alias("server"), null("bigint").alias("wait_ns"), F.when(k % 17 != 0, F.floor(F.col("value") * 20).cast("bigint") * 1_000_000).alias("response_ns"), null("bigint").alias("total_ns"),
        F.when(k % 3 != 0, F.when(k % 4 == 0, "HIT").when(k % 4 == 1, "MISS").when(k % 4 == 2, "STALE").otherwise("BYPASS")).alias("cache"), F.when(error & (k % 4 == 3), "sD--").alias("term_state"), (k % 10 != 0).alias("client_identity"),
    )


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prepared(access_events(spark, sf_dir), DEFAULT.column())


def _named(df: DataFrame) -> DataFrame:
    """The total under the name "(all)", as the SQL has it."""
    return df.withColumn("cls", F.coalesce("cls", F.lit("(all)")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else VIEW_SQL + sql
        return f

    return register


# Parsers: the view is written as lines of a dialect and read back.


def _clock(form: str):
    return F.date_format("ts", form)


def _wait(none: str):
    return F.coalesce((F.col("response_ns") / 1_000_000).cast("bigint").cast("string"), F.lit(none))


def _target():
    return F.concat("path", F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise(""))


def render(events: DataFrame, dialect: str) -> DataFrame:
    """Lines of a dialect for events; what the dialect can't say is left out."""
    s = lambda c: F.col(c).cast("string")
    who = F.when(F.col("client_identity"), "198.51.100.9")
    if dialect == "haproxy":
        line = F.concat(F.coalesce(F.concat(who, F.lit(":5000 ")), F.lit("- ")), F.lit("["), _clock("dd/MMM/yyyy:HH:mm:ss.SSS"), F.lit("] web app/s1 0/0/1/"), _wait("-1"), F.lit("/-1 "), s("status"), F.lit(" "), s("bytes"), F.lit(" - - "), F.coalesce("term_state", F.lit("----")), F.lit(" 1/1/0/0/0 0/0 {"), "host", F.lit('} "GET '), _target(), F.lit(' HTTP/1.1"'))
    elif dialect == "nginx":
        line = F.concat(F.coalesce(who, F.lit("-")), F.lit(" - - ["), _clock("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), _target(), F.lit(' HTTP/1.1" '), s("status"), F.lit(" "), s("bytes"), F.lit(' "-" "agent" '), F.coalesce("cache", F.lit("-")), F.coalesce(F.concat(F.lit(" "), F.format_string("%.3f", F.col("response_ns") / 1e9)), F.lit("")))
    elif dialect == "traefik":
        line = F.to_json(F.struct(F.concat(_clock("yyyy-MM-dd"), F.lit("T"), _clock("HH:mm:ss"), F.lit("Z")).alias("StartUTC"), F.col("method").alias("RequestMethod"), _target().alias("RequestPath"), F.col("host").alias("RequestHost"), F.col("status").alias("DownstreamStatus"), F.col("bytes").alias("DownstreamContentSize"), F.col("response_ns").alias("OriginDuration"), F.lit("app").alias("ServiceName"), who.alias("ClientHost"), F.col("cache").alias("request_Cache-Status")))
    elif dialect == "cloudfront":
        line = F.concat_ws("\t", _clock("yyyy-MM-dd"), _clock("HH:mm:ss"), F.coalesce(who, F.lit("-")), "method", "host", "path", s("status"), F.when(F.col("query") == "", "-").otherwise(F.col("query")), F.coalesce("cache", F.lit("-")), s("bytes"), F.coalesce(F.format_string("%.3f", F.col("response_ns") / 1e9), F.lit("-")))
    else:
        line = F.to_json(F.struct(s("epoch").alias("reqTimeSec"), F.col("method").alias("reqMethod"), F.col("path").alias("reqPath"), F.col("query").alias("queryStr"), F.col("host").alias("reqHost"), s("status").alias("statusCode"), F.when(F.col("cache") == "HIT", "1").when(F.col("cache") == "MISS", "0").alias("cacheStatus"), _wait("-").alias("turnAroundTimeMSec"), F.col("bytes").alias("totalBytes"), F.coalesce(who, F.lit("-")).alias("cliIP")))
    return events.withColumn("epoch", F.unix_seconds("ts")).select(F.lit(0).alias("file_idx"), F.lit(0).cast("long").alias("line_block"), F.col("ord").cast("long").alias("line_no"), line.alias("value"))


CLOUDFRONT_HEADER = "#Fields: date time c-ip cs-method cs(host) cs-uri-stem sc-status cs-uri-query x-edge-result-type sc-bytes time-to-first-byte"


def _with_header(lines: DataFrame, header: str = CLOUDFRONT_HEADER) -> DataFrame:
    """Lines in blocks of 4,096 requests, as a file is read in blocks, with a header in front of the first."""
    lines = lines.withColumn("line_block", F.floor(F.col("line_no") / 4096))
    head = lines.sparkSession.createDataFrame([(0, 0, -1, header)], "file_idx int, line_block long, line_no long, value string")
    return head.unionByName(lines)


def _parsed(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    # The table is one small file and so one split; a log's lines come in as many as there are cores.
    lines = render(access_events(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism), dialect)
    got = dialects.parse(_with_header(lines) if dialect == "cloudfront" else lines, dialect).where("parse_status = 'parsed'")
    return got.select(F.col("line_no").alias("ord"), F.unix_seconds("ts").alias("sec"), "path", "query", F.col("status").cast("int").alias("status"), F.floor(latency_ns() / 1_000_000).cast("bigint").alias("ms"), F.coalesce("cache", F.lit("-")).alias("cache"), F.col("client_identity").alias("identity"), F.coalesce("term_state", F.lit("-")).alias("term"), "host" if dialect != "nginx" else F.lit("-").alias("host"), "bytes")


def _parse_sql(cache: str = "coalesce(cache, '-')", term: str = "'-'", host: str = "host") -> str:
    return f"SELECT ord, sec, path, query, CAST(status AS INT) AS status, ms, {cache} AS cache, identity, {term} AS term, {host} AS host, CAST(bytes AS BIGINT) AS bytes FROM a"


@query(_parse_sql(cache="'-'", term="coalesce(term, '-')"))
def parse_haproxy(spark, sf_dir):
    return _parsed(spark, sf_dir, "haproxy")


@query(_parse_sql(host="'-'").replace(" ms,", " CAST(floor(floor(ms / 1000::DOUBLE * 1e9) / 1e6) AS BIGINT) AS ms,"))  # its seconds are cut, not rounded
def parse_nginx(spark, sf_dir):
    return _parsed(spark, sf_dir, "nginx")


@query(_parse_sql().replace("SELECT ord, sec, path, query, CAST(status AS INT) AS status, ms,", "SELECT ord, sec, path, query, CAST(status AS INT) AS status, CASE WHEN ms > 0 THEN ms END AS ms,"))
def parse_traefik(spark, sf_dir):
    return _parsed(spark, sf_dir, "traefik")


@query(_parse_sql())
def parse_cloudfront(spark, sf_dir):
    return _parsed(spark, sf_dir, "cloudfront")


@query(_parse_sql(cache="CASE WHEN cache IN ('HIT', 'MISS') THEN cache ELSE '-' END"))
def parse_akamai(spark, sf_dir):
    return _parsed(spark, sf_dir, "akamai")


@query("SELECT d.dialect, count(*) * (d.dialect = 'haproxy')::BIGINT AS parsed FROM a, (VALUES ('haproxy'), ('nginx'), ('traefik'), ('cloudfront'), ('akamai')) d(dialect) GROUP BY d.dialect")
def detect_vote(spark, sf_dir):
    """How many lines of a HAProxy log each parser reads."""
    return votes(render(access_events(spark, sf_dir), "haproxy"))


_NOISE = "CASE WHEN ord % 10 = 3 THEN 'skipped' WHEN ord % 10 = 7 THEN 'malformed' ELSE 'parsed' END"


@query(f"SELECT {_NOISE} AS parse_status, count(*) AS lines, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS share FROM a GROUP BY 1")
def scan_counts(spark, sf_dir):
    """A tenth of the lines is a daemon message, another has its timers cut off."""
    lines = render(access_events(spark, sf_dir), "haproxy")
    mod = F.col("line_no") % 10
    lines = lines.withColumn("value", F.when(mod == 3, "proxy web started.").when(mod == 7, F.concat(F.substring_index("value", "] ", 1), F.lit("] web app/s1"))).otherwise(F.col("value")))
    counts = M.Tables(cells_of(dialects.parse(lines, "haproxy").withColumn("ord", place()), Options().checked())).lines().withColumnRenamed("count", "lines")
    return counts.join(F.broadcast(counts.agg(F.sum("lines").alias("__n"))), F.lit(True)).select("parse_status", "lines", (F.col("lines") / F.col("__n")).alias("share"))


def _noise(value, dialect: str, mod):
    """A tenth of a dialect's lines is no request, another is a request spoilt in one field."""
    other = {"nginx": "# comment", "traefik": '{"level":"info","msg":"up"}', "cloudfront": "#Version: 1.0", "akamai": '{"version":1}'}
    cut = F.substring(value, F.lit(1), F.length(value) - 3)
    spoilt = {"nginx": F.regexp_replace(value, r'" \d+ ', '" 2x0 '), "cloudfront": F.regexp_replace(value, r"^[^\t]*", "-")}
    return F.when(mod == 3, other[dialect]).when(mod == 7, spoilt.get(dialect, cut)).otherwise(value)


@query(f"SELECT d.dialect, {_NOISE} AS parse_status, count(*) AS lines FROM a, (VALUES ('nginx'), ('traefik'), ('cloudfront'), ('akamai')) d(dialect) GROUP BY ALL")
def noise_counts(spark, sf_dir):
    """Skipped and malformed lines of the other four dialects."""
    out = None
    for name in ("nginx", "traefik", "cloudfront", "akamai"):
        lines = render(access_events(spark, sf_dir), name)
        lines = lines.withColumn("value", _noise(F.col("value"), name, F.col("line_no") % 10))
        got = dialects.parse(_with_header(lines) if name == "cloudfront" else lines, name).where("line_no >= 0")
        got = got.groupBy("parse_status").agg(F.count(F.lit(1)).alias("lines")).select(F.lit(name).alias("dialect"), "parse_status", "lines")
        out = got if out is None else out.unionByName(got)
    return out


_STRICT = """SELECT d.dialect, CASE WHEN ord % 10 IN (1, 2, 3, 5, 6) THEN 'malformed' ELSE 'parsed' END AS parse_status, ord % 10 AS form, count(*) AS lines,
  CAST(sum(CASE WHEN ord % 10 IN (1, 2, 3, 5, 6) THEN 0 WHEN ord % 10 = 4 THEN 299 ELSE status END) AS BIGINT) AS status_sum,
  count(DISTINCT CASE WHEN ord % 10 NOT IN (1, 2, 3, 5, 6) THEN path END) AS paths FROM a, (VALUES ('traefik'), ('akamai')) d(dialect) GROUP BY ALL"""


@query(_STRICT)
def json_decode(spark, sf_dir):
    """JSON lines in ten forms: text or an object behind, an early close, repeated keys (the last counts, null doesn't, a misfit spoils), changed case, single quotes."""
    out = None
    for name, code, method in (("traefik", "DownstreamStatus", "RequestMethod"), ("akamai", "statusCode", "reqMethod")):
        lines = render(access_events(spark, sf_dir), name)
        v, form = F.col("value"), F.col("line_no") % 10
        more = lambda tail: F.concat(F.substring(v, F.lit(1), F.length(v) - 1), F.lit(f",{tail}}}"))
        turned = F.regexp_replace(F.regexp_replace(v, f'"{code}"', f'"{code.upper()}"'), f'"{method}"', f'"{method.lower()}"')
        odd = F.when(form == 1, F.concat(v, F.lit(" x"))).when(form == 2, F.concat(v, F.lit("]"))).when(form == 3, F.concat(v, F.lit(","), v)).when(form == 4, more(f'"{code}":299')).when(form == 5, more(f'"{method}":7,"{method}":"GET"'))
        odd = odd.when(form == 6, F.translate(v, '"', "'")).when(form == 7, more(f'"{code}":null')).when(form == 8, turned).when(form == 9, more('"other":{"a":[1,"]"]}')).otherwise(v)
        got = dialects.parse(lines.withColumn("value", odd), name)
        got = got.groupBy("parse_status", form.cast("bigint").alias("form")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.coalesce("status", F.lit(0))).alias("status_sum"), F.countDistinct("path").alias("paths"))
        got = got.select(F.lit(name).alias("dialect"), "*")
        out = got if out is None else out.unionByName(got)
    return out


def _written(lines: DataFrame, parts: int = 3) -> str:
    """A folder of gzip files by names that don't say so, in order of ``line_no``."""
    spark = lines.sparkSession
    folder = shared_folder(spark, "logs")
    lines.repartitionByRange(parts, "line_no").sortWithinPartitions("line_no").select("value").write.option("compression", "gzip").text(folder)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in resolve(spark, [folder]):
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(name), spark._jvm.org.apache.hadoop.fs.Path(name.removesuffix(".txt.gz") + ".log"))
    return folder


_RAW = "ord || ' ' || path || ' ' || status || chr(9) || host"


@query(f"SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS BIGINT) AS at, {_RAW} AS value FROM a")
def log_lines(spark, sf_dir):
    """Lines of a log of several gzip files, written and read back in order: each file's range count, then its lines."""
    e = access_events(spark, sf_dir)
    raw = F.concat_ws("\t", F.concat_ws(" ", "ord", "path", "status"), "host")
    folder = _written(e.select(F.lit(0).alias("file_idx"), F.col("ord").alias("line_no"), raw.alias("value")))
    lines = read_lines(spark, [folder], split=50_000).withColumn("ord", place()).select("file_idx", "line_block", "ord", "value")
    within = F.row_number().over(Window.partitionBy("file_idx", "line_block").orderBy("ord"))
    before = Window.orderBy("file_idx", "line_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = lines.groupBy("file_idx", "line_block").count().select("file_idx", "line_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return lines.withColumn("n", within).join(F.broadcast(starts), ["file_idx", "line_block"]).select((F.col("start") + F.col("n") - 1).cast("bigint").alias("at"), "value")


@query("SELECT d.dialect, (d.dialect = 'nginx')::BIGINT * least(200, count(*)) AS parsed FROM a, (VALUES ('haproxy'), ('nginx'), ('traefik'), ('cloudfront'), ('akamai')) d(dialect) GROUP BY d.dialect")
def detect_sample(spark, sf_dir):
    """The vote on the head of a written log alone, as a run takes it."""
    folder = _written(render(access_events(spark, sf_dir), "nginx"))
    return head_votes(spark, resolve(spark, [folder])[0])


@query("SELECT ord, sec, status, path FROM a WHERE ord <> 5000")
def cloudfront_reheader(spark, sf_dir):
    """A second header midway reorders the columns: every line goes by the latest one before it."""
    lines = _reheadered(access_events(spark, sf_dir))
    got = dialects.parse(_with_header(lines), "cloudfront").where("parse_status = 'parsed'")
    return got.select(F.col("line_no").alias("ord"), F.unix_seconds("ts").alias("sec"), F.col("status").cast("int").alias("status"), "path")


def _reheadered(e: DataFrame) -> DataFrame:
    """CloudFront lines; from the request 5000 on, which is a header, columns come in another order."""
    lines, turned = render(e, "cloudfront"), F.split("value", "\t")
    return lines.withColumn("value", F.when(F.col("line_no") > 5000, F.concat_ws("\t", F.get(turned, F.lit(6)), F.get(turned, F.lit(5)), F.get(turned, F.lit(1)), F.get(turned, F.lit(0)))).when(F.col("line_no") == 5000, F.lit("#Fields: sc-status cs-uri-stem time date")).otherwise(F.col("value")))


@query(ORACLE_SQL["cloudfront_reheader"].removeprefix(VIEW_SQL))
def stream_cloudfront(spark, sf_dir):
    """The same log dealt over four files, whose lines come in two triggers of a stream, started anew between them."""
    lines = _reheadered(access_events(spark, sf_dir)).where("line_no <> 5000").withColumn("file", F.concat(F.lit("f"), (F.col("line_no") % 4).cast("string")))
    heads = [(f"f{i}", 0, no, value) for i in range(4) for no, value in ((-1, CLOUDFRONT_HEADER), (5000, "#Fields: sc-status cs-uri-stem time date"))]
    lines = lines.select("file", "line_block", "line_no", "value").unionByName(spark.createDataFrame(heads, "file string, line_block long, line_no long, value string"))
    folder, out, mark = (shared_folder(spark, n) for n in ("arriving", "streamed", "mark"))
    for part in ("line_no < 7000", "line_no >= 7000"):
        lines.where(part).write.mode("append").parquet(folder)
        read = spark.readStream.schema(lines.schema).parquet(folder)
        parsed = dialects.parse(with_heads_stream(read, ttl_ms=None), "cloudfront").where("parse_status = 'parsed'")
        parsed.select("line_no", "ts", "status", "path").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("line_no").alias("ord"), F.unix_seconds("ts").alias("sec"), F.col("status").cast("int").alias("status"), "path")


# Aggregates.


@query("SELECT count(*) FILTER (sec >= lo + 100 AND sec < lo + 300) AS in_window, count(*) FILTER (NOT (sec >= lo + 100 AND sec < lo + 300)) AS outside FROM a, (SELECT min(sec) AS lo FROM a)")
def window_filter(spark, sf_dir):
    e = access_events(spark, sf_dir)
    lo = e.agg(F.min("ts")).first()[0]
    inside = in_window(Options(since=lo + timedelta(seconds=100), until=lo + timedelta(seconds=300)))
    return e.agg(F.count_if(inside).alias("in_window"), F.count_if(~inside).alias("outside"))


_CELLS = {"second": ("sec", "NULL"), "wait": ("ms", "NULL"), "path": ("NULL", "path"), "status_class": ("NULL", "status_class"), "cache": ("NULL", "cache"), "term_state": ("NULL", "term"), "host": ("NULL", "host")}


@query(
    " UNION ALL ".join(f"SELECT '{kind}' AS kind, cls, CAST({num} AS BIGINT) AS num, CAST({label} AS VARCHAR) AS label, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (identity) AS identified, count(ms) AS measured, CAST(sum(ms * 1000000) AS BIGINT) AS lat_sum_ns, count(cache) AS judged, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (status >= 500) AS fivexx, CAST(min(ord) AS BIGINT) AS first_ord, CAST(max(ord) AS BIGINT) AS last_ord FROM b WHERE {num if label == 'NULL' else label} IS NOT NULL GROUP BY ALL" for kind, (num, label) in _CELLS.items())
)
def report_cells(spark, sf_dir):
    """The one pass that all tables of a report are made of."""
    sums = ("requests", "bytes", "identified", "measured", "lat_sum_ns", "judged", "ok", "fivexx")
    got = cells_of(access_events(spark, sf_dir), Options().checked())
    return got.select("kind", "cls", "num", "label", *sums, *[F.col(c).cast("bigint").alias(c) for c in ("first_ord", "last_ord")])


@query(ORACLE_SQL["report_cells"].removeprefix(VIEW_SQL))
def stored_days(spark, sf_dir):
    """The cells of three stored runs, one after the other in the log, added up."""
    e, store = access_events(spark, sf_dir), shared_folder(spark, "cells")
    last = e.agg(F.max("ord")).first()[0]
    for i in range(3):
        cell_store.put(e.where(F.floor(F.col("ord") * 3 / (last + 1)) == i), store, f"day-{i}", "nginx")
    _, got = cell_store.cells(spark, store)
    place = lambda c: (F.col(c) % F.lit(Decimal(1 << 108))).cast("bigint").alias(c)
    sums = ("requests", "bytes", "identified", "measured", "lat_sum_ns", "judged", "ok", "fivexx")
    return got.select("kind", "cls", "num", "label", *sums, place("first_ord"), place("last_ord"))


@query("SELECT cls, count(*) AS requests, count(*) / (SELECT count(*) FROM a)::DOUBLE AS share, CAST(sum(bytes) AS BIGINT) AS bytes FROM b GROUP BY cls")
def classify_mix(spark, sf_dir):
    s = M.summary(prepared(spark, sf_dir))
    total = s.where("cls is null").select(F.col("requests").alias("__n"))
    return s.where("cls is not null").join(F.broadcast(total), F.lit(True)).select("cls", "requests", (F.col("requests") / F.col("__n")).alias("share"), "bytes")


_KINDS_OF_EVENT = ("click", "error", "purchase", "signup", "view")


def many_rules() -> ClassSet:
    """2,000 rules by arithmetic, every fifth by another kind of term; the first of a request may be any of them."""

    def rule(i: int) -> Rule:
        v, name = 399 - i // 5, f"r{i:04d}"
        kind = _KINDS_OF_EVENT[v % 5]
        match i % 5:
            case 0:
                return Rule(name, path_prefixes=(f"/API/{kind}/{v % 40}",))
            case 1:
                return Rule(name, path_suffixes=(f"/{v}.js",))
            case 2:
                return Rule(name, path_contains=(f"{kind[1:]}/{v}",))
            case 3:
                return Rule(name, query_params=("_rsc" if v == 20 else f"p{v}",))
        return Rule(name, path_prefixes=(f"/{kind}/{v // 5}",), methods=("get",) if v < 100 else ("POST", "put"))

    return ClassSet(tuple(rule(i) for i in range(2000)), "rest")


_MANY_RULES = """, rules AS (SELECT i, i % 5 AS how, 399 - i // 5 AS v, ['click', 'error', 'purchase', 'signup', 'view'][CAST((399 - i // 5) % 5 + 1 AS INT)] AS kind FROM range(2000) t(i)),
u AS (SELECT DISTINCT path, query FROM a),
firsts AS (SELECT path, query, min(i) AS i FROM u JOIN rules ON
  CASE how WHEN 0 THEN starts_with(path, '/api/' || kind || '/' || (v % 40)) WHEN 1 THEN suffix(path, '/' || v || '.js') WHEN 2 THEN contains(path, substr(kind, 2) || '/' || v)
    WHEN 3 THEN starts_with(query, CASE WHEN v = 20 THEN '_rsc' ELSE 'p' || v END || '=') ELSE v < 100 AND starts_with(path, '/' || kind || '/' || (v // 5)) END GROUP BY path, query)
SELECT ord, coalesce('r' || lpad(CAST(i AS VARCHAR), 4, '0'), 'rest') AS cls FROM a LEFT JOIN firsts USING (path, query)"""


@query(_MANY_RULES)
def classify_many_rules(spark, sf_dir):
    """Every request by 2,000 rules."""
    return access_events(spark, sf_dir).select("ord", many_rules().column().alias("cls"))


_SECONDS = ", s AS (SELECT cls, sec, count(*) AS n, max(ord) AS last_ord FROM g GROUP BY ALL), w AS (SELECT max(sec) - min(sec) + 1 AS w FROM a) "


@query(_SECONDS + "SELECT cls, max(n) AS peak, arg_min(sec, {'n': -n, 'o': last_ord}) AS peak_sec FROM s GROUP BY cls")
def class_peaks(spark, sf_dir):
    return _named(M.peaks(M.per_second(prepared(spark, sf_dir))).select("cls", "peak", "peak_sec"))


@query(_SECONDS + "SELECT cls, max(n) AS peak, arg_min(sec, {'n': -n, 'o': last_ord}) AS peak_sec FROM s WHERE cls = '(all)' GROUP BY cls")
def rate_peak(spark, sf_dir):
    return _named(M.peaks(M.per_second(prepared(spark, sf_dir)).where("cls is null")).select("cls", "peak", "peak_sec"))


@query(_SECONDS + "SELECT (SELECT w FROM w) AS window_seconds, count(DISTINCT sec) AS busy_seconds, greatest(0, (SELECT w FROM w) - count(DISTINCT sec)) AS silent_seconds FROM s WHERE cls = '(all)'")
def silent_seconds(spark, sf_dir):
    p = prepared(spark, sf_dir)
    busy = M.peaks(M.per_second(p).where("cls is null")).select("busy_seconds")
    window = M.summary(p).where("cls is null").select(M.window_seconds(F.col("first_ts"), F.col("last_ts")).alias("window_seconds"))
    return window.join(F.broadcast(busy), F.lit(True)).select("window_seconds", "busy_seconds", F.greatest(F.lit(0).cast("bigint"), F.col("window_seconds") - F.col("busy_seconds")).alias("silent_seconds"))


@query(
    _SECONDS
    + """, r AS (SELECT cls, n, row_number() OVER (PARTITION BY cls ORDER BY n, sec) AS rn, count(*) OVER (PARTITION BY cls) AS d FROM s),
q AS (SELECT DISTINCT cls, d, q, least(greatest(CAST(floor(q * w + 0.5) AS BIGINT) - 1, 0), w - 1) AS idx, greatest(w - d, 0) AS silent FROM r, w, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) v(q))
SELECT q.cls, q.q, CASE WHEN idx < silent THEN 0 ELSE (SELECT r.n FROM r WHERE r.cls = q.cls AND r.rn = least(idx - silent, q.d - 1) + 1) END AS value FROM q"""
)
def rate_percentiles(spark, sf_dir):
    p = prepared(spark, sf_dir)
    w = M.summary(p).where("cls is null").select(M.window_seconds(F.col("first_ts"), F.col("last_ts"))).first()[0]
    return _named(M.rate_percentiles(M.per_second(p), w))


@query(
    """, h AS (SELECT cls, ms, count(*) AS n FROM g WHERE ms IS NOT NULL GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY cls ORDER BY ms) AS cum, sum(n) OVER (PARTITION BY cls) AS total FROM h)
SELECT cls, q, min(ms) AS value FROM c, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) v(q) WHERE cum >= least(greatest(CAST(floor(q * total + 0.5) AS BIGINT) - 1, 0), total - 1) + 1 GROUP BY cls, q"""
)
def wait_percentiles(spark, sf_dir):
    return _named(M.wait_percentiles(M.wait_histogram(prepared(spark, sf_dir))))


@query("SELECT cls, t AS over_ms, count(*) FILTER (ms > t) AS n, count(*) FILTER (ms > t) / count(*)::DOUBLE AS share FROM g, (VALUES (1000::BIGINT), (3000::BIGINT), (7000::BIGINT)) v(t) WHERE ms IS NOT NULL GROUP BY cls, t")
def wait_tails(spark, sf_dir):
    return _named(M.tails(M.wait_histogram(prepared(spark, sf_dir)), (1000, 3000, 7000)).drop("place"))


@query("SELECT cls, count(ms) AS measured, max(ms) AS max_ms, CAST(sum(ms * 1000000) AS BIGINT) AS lat_sum_ns FROM g GROUP BY cls")
def wait_totals(spark, sf_dir):
    return _named(M.summary(prepared(spark, sf_dir)).select("cls", "measured", "max_ms", "lat_sum_ns"))


@query("SELECT cls, status_class AS label, count(*) AS n FROM g GROUP BY ALL")
def status_mix(spark, sf_dir):
    return _named(M.label_counts(prepared(spark, sf_dir), "status_class"))


_HIT = "cache IN ('HIT', 'STALE')"


@query(f"SELECT cls, count(cache) AS judged, count(*) FILTER ({_HIT}) AS hits, count(*) FILTER ({_HIT}) / count(cache)::DOUBLE AS hit_ratio FROM g GROUP BY cls")
def cache_ratio(spark, sf_dir):
    return _named(M.summary(prepared(spark, sf_dir)).select("cls", "judged", "hits", F.try_divide("hits", "judged").alias("hit_ratio")))


_TOP = "CAST(row_number() OVER (PARTITION BY cls ORDER BY n DESC, label) AS INT) AS place"


@query(f", c AS (SELECT cls, cache AS label, count(*) AS n FROM g WHERE cache IS NOT NULL GROUP BY ALL) SELECT * FROM (SELECT *, {_TOP} FROM c) WHERE place <= 2")
def cache_verdicts(spark, sf_dir):
    return _named(M.top_labels(M.label_counts(prepared(spark, sf_dir), "cache"), 2))


@query(f"SELECT cls, count(cache) AS judged, count(*) FILTER ({_HIT}) / count(cache)::DOUBLE AS hit_ratio FROM b GROUP BY cls HAVING count(cache) >= 100 AND count(*) FILTER ({_HIT}) / count(cache)::DOUBLE < 0.6")
def cold_classes(spark, sf_dir):
    s = M.summary(prepared(spark, sf_dir)).where("cls is not null and judged >= 100").withColumn("hit_ratio", F.col("hits") / F.col("judged"))
    return s.where("hit_ratio < 0.6").select("cls", "judged", "hit_ratio")


_PATHS = ", p AS (SELECT cls, path, count(*) AS n, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (status >= 500) AS fivexx, min(ord) AS first_ord FROM g GROUP BY ALL) "
_RANK = "CAST(row_number() OVER (PARTITION BY cls ORDER BY {}, path) AS INT) AS place"


@query(_PATHS + f"SELECT cls, path, n, ok, place FROM (SELECT *, {_RANK.format('n DESC')} FROM p) WHERE place <= 10 AND cls = '(all)'")
def top_paths(spark, sf_dir):
    return _named(M.top_paths(M.path_stats(prepared(spark, sf_dir)).where("cls is null"), 10)).select("cls", "path", "n", "ok", "place")


@query(_PATHS + f"SELECT cls, path, n, ok, place FROM (SELECT *, {_RANK.format('n DESC')} FROM p) WHERE place <= 5 AND cls <> '(all)'")
def top_paths_by_class(spark, sf_dir):
    return M.top_paths(M.path_stats(prepared(spark, sf_dir)).where("cls is not null"), 5).select("cls", "path", "n", "ok", "place")


@query(_PATHS + f"SELECT cls, path, fivexx, place FROM (SELECT *, {_RANK.format('fivexx DESC')} FROM p WHERE fivexx > 0) WHERE place <= 10 AND cls = '(all)'")
def top_5xx(spark, sf_dir):
    return _named(M.top_5xx(M.path_stats(prepared(spark, sf_dir)).where("cls is null"), 10)).select("cls", "path", "fivexx", "place")


@query(_PATHS + "SELECT cls, count(*) AS distinct_paths FROM p GROUP BY cls")
def distinct_paths(spark, sf_dir):
    return _named(M.path_stats(prepared(spark, sf_dir)).groupBy("cls").agg(F.count(F.lit(1)).alias("distinct_paths")))


@query(_PATHS + ", r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY first_ord) AS rn FROM p) SELECT cls, count(*) FILTER (rn <= 50) AS kept, coalesce(sum(n) FILTER (rn > 50), 0)::BIGINT AS dropped_requests FROM r GROUP BY cls")
def path_cap(spark, sf_dir):
    """Requests beyond the first 50 paths seen, counted once for each of class and total."""
    paths = M.path_stats(prepared(spark, sf_dir)).persist()
    kept = M.cap_paths(paths, 50, [None, *DEFAULT.names()]).groupBy("cls").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("__k"))
    total = paths.groupBy("cls").agg(F.sum("n").alias("__n")).withColumnRenamed("cls", "__c")
    return _named(kept.join(total, F.col("cls").eqNullSafe(F.col("__c"))).select("cls", "kept", (F.col("__n") - F.col("__k")).alias("dropped_requests")))


@query(", c AS (SELECT term AS label, count(*) AS n FROM a WHERE term IS NOT NULL GROUP BY ALL) SELECT label, n, n / (SELECT count(*) FROM a)::DOUBLE AS share FROM c ORDER BY n DESC, label LIMIT 5")
def termination_top5(spark, sf_dir):
    p = prepared(spark, sf_dir)
    n = p.agg(F.count(F.lit(1)).alias("__n"))
    return M.top_labels(M.label_counts(p, "term_state").where("cls is null"), 5).join(F.broadcast(n), F.lit(True)).select("label", "n", (F.col("n") / F.col("__n")).alias("share"))


@query("SELECT host AS label, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, label LIMIT 20")
def top_hosts(spark, sf_dir):
    return M.top_labels(M.label_counts(prepared(spark, sf_dir), "host").where("cls is null"), 20).select("label", "n")


@query("SELECT count(*) FILTER (identity) AS with_identity, count(*) FILTER (identity) / count(*)::DOUBLE AS identity_share, count(*) FILTER (identity) / count(*)::DOUBLE >= 0.99 AS countable FROM a")
def audience(spark, sf_dir):
    s = M.summary(prepared(spark, sf_dir)).where("cls is null")
    return s.select(F.col("identified").alias("with_identity"), (F.col("identified") / F.col("requests")).alias("identity_share"), (F.col("identified") / F.col("requests") >= 0.99).alias("countable"))


@query(ORACLE_SQL["wait_percentiles"].replace("SELECT cls, q, min(ms) AS value FROM c", "SELECT * FROM (SELECT cls, min(ms) AS p95 FROM c").replace("(0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)", "(0.95::DOUBLE)").replace("GROUP BY cls, q", "AND cls <> '(all)' GROUP BY cls) ORDER BY p95 DESC, list_position(['rsc_nav', 'media', 'static', 'search', 'api', 'doc'], cls) LIMIT 1"))
def slowest_class(spark, sf_dir):
    p95 = M.wait_percentiles(M.wait_histogram(prepared(spark, sf_dir)).where("cls is not null"), (0.95,))
    order = F.array_position(F.lit(DEFAULT.names()), F.col("cls"))
    return p95.orderBy(F.desc("value"), order).limit(1).select("cls", F.col("value").alias("p95"))


@query("SELECT cls, count(*) AS requests FROM b GROUP BY cls ORDER BY requests DESC, list_position(['rsc_nav', 'media', 'static', 'search', 'api', 'doc'], cls) LIMIT 1")
def largest_class(spark, sf_dir):
    order = F.array_position(F.lit(DEFAULT.names()), F.col("cls"))
    return M.summary(prepared(spark, sf_dir)).where("cls is not null").orderBy(F.desc("requests"), order).limit(1).select("cls", "requests")


@query(_PATHS + f"SELECT cls, path, n, place FROM (SELECT *, {_RANK.format('n DESC')} FROM p WHERE cls <> '(all)' AND ok / n::DOUBLE >= 0.95) WHERE place <= 40")
def pools(spark, sf_dir):
    return M.pools(M.path_stats(prepared(spark, sf_dir)), 40, 0.95).select("cls", "path", "n", "place")


# Predicates and tokenising over other tables.

_HEX = "md5(CAST(o_orderkey AS VARCHAR))"


@query(f"WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '/t/' || substr({_HEX}, 1, 24) WHEN o_orderkey % 3 = 1 THEN '/news/' || o_orderkey ELSE '/a-slug-with-' || substr({_HEX}, 1, 20) END AS path FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 4 * length(regexp_replace(substr(path, 4), '[^0-9]', '', 'g')) >= 24 ELSE FALSE END AS secret FROM s")
def secret_paths(spark, sf_dir):
    key, h = F.col("o_orderkey"), F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    path = F.when(key % 3 == 0, F.concat(F.lit("/t/"), F.substring(h, 1, 24))).when(key % 3 == 1, F.concat(F.lit("/news/"), key.cast("string"))).otherwise(F.concat(F.lit("/a-slug-with-"), F.substring(h, 1, 20)))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.looks_secret(path).alias("secret"))


@query("WITH p AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) SELECT page_id, host, length(host) <= 253 AND regexp_full_match(host, '[A-Za-z0-9._-]+(:[^:]*)?') AND contains(split_part(host, ':', 1), '.') AS is_host FROM p")
def host_shape(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), T.is_host(host).alias("is_host"))


@query("WITH p AS (SELECT page_id, CASE WHEN contains(url, '?') THEN regexp_extract(url, '[?](.*)$', 1) ELSE '' END AS query FROM pages) SELECT page_id, query, len(list_filter(regexp_split_to_array(query, '[&;]'), lambda x: x = 'ref' OR starts_with(x, 'ref='))) > 0 AS has_ref FROM p")
def query_param(spark, sf_dir):
    q = T.after_mark(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", q.alias("query"), T.has_param(q, "ref").alias("has_ref"))


@query("SELECT ord, CAST(13 AS INT) AS n_tokens, '{' || host || '}' AS captured, '\"GET ' || path || (CASE WHEN query <> '' THEN '?' || query ELSE '' END) || ' HTTP/1.1\"' AS request FROM a")
def tokenise(spark, sf_dir):
    t = render(access_events(spark, sf_dir), "haproxy").select(F.col("line_no").alias("ord"), T.tokens(F.regexp_replace("value", r"^\S+ ", "")).alias("t"))
    return t.select("ord", F.size("t").alias("n_tokens"), F.get("t", F.size("t") - 2).alias("captured"), F.element_at("t", -1).alias("request"))


# Findings and the profile.


def _report(spark: SparkSession, sf_dir: str, dialect: str = "nginx", **kw) -> dict:
    e = access_events(spark, sf_dir)
    n = e.count()
    return build(e, dialect, "events", Counts(n, n, 0, 0), Options(**kw))


@query(None)
def findings(spark, sf_dir):
    rows = [tuple(f.values()) for f in _report(spark, sf_dir)["findings"]]
    return spark.createDataFrame(rows, FINDING_SCHEMA)


_ORDER = "list_position(['rsc_nav', 'media', 'static', 'search', 'api', 'doc'], cls)"
_RANKED = "least(greatest(CAST(floor(0.95::DOUBLE * {0} + 0.5) AS BIGINT) - 1, 0), {0} - 1)"
_FINDINGS = f""", w AS (SELECT max(sec) - min(sec) + 1 AS w, count(DISTINCT sec) AS busy, count(*) AS n FROM a),
s AS (SELECT sec, count(*) AS n FROM a GROUP BY sec), pk AS (SELECT max(n)::DOUBLE AS peak FROM s), rs AS (SELECT n, row_number() OVER (ORDER BY n) AS rn FROM s),
i AS (SELECT w, w - busy AS silent, n, {_RANKED.format("w")} AS idx FROM w), q AS (SELECT CASE WHEN idx < silent THEN 0 ELSE (SELECT rs.n FROM rs WHERE rs.rn = idx - silent + 1) END AS p95 FROM i),
l AS (SELECT cls, ms, row_number() OVER (PARTITION BY cls ORDER BY ms) AS rn, count(*) OVER (PARTITION BY cls) AS m FROM g WHERE ms IS NOT NULL),
p AS (SELECT cls, ms::DOUBLE AS p95 FROM l WHERE rn = {_RANKED.format("m")} + 1),
t AS (SELECT count(*) FILTER (ms > 1000) AS o1, count(*) FILTER (ms > 7000) AS o7, count(*)::DOUBLE AS m FROM a WHERE ms IS NOT NULL),
e AS (SELECT count(*) FILTER (status BETWEEN 500 AND 599) AS x, count(*)::DOUBLE AS n, count(*) FILTER (term LIKE 'sD%') AS d, count(*) FILTER (identity) AS who FROM a),
k AS (SELECT cls, count(*) AS n, count(cache) AS judged, count(*) FILTER ({_HIT}) / count(cache)::DOUBLE AS ratio FROM g GROUP BY cls),
f AS (
SELECT 'coverage' AS "check", 'window' AS target, 'WARN' AS status, silent / w::DOUBLE * 100 AS value, '%' AS unit FROM i WHERE n >= w AND silent / w::DOUBLE >= 0.20
UNION ALL SELECT 'rate', 'peak second', 'OK', peak, 'req/s' FROM pk
UNION ALL SELECT 'rate', 'burstiness', 'WARN', peak / p95, '×' FROM pk, q WHERE p95 > 0 AND peak / p95 >= 3
UNION ALL SELECT 'wait', 'all classes', 'OK', p95, 'ms' FROM p WHERE cls = '(all)'
UNION ALL SELECT 'wait', 'read timeout', CASE WHEN o7 / m >= 0.001 THEN 'BAD' WHEN o7 > 0 THEN 'WARN' ELSE 'OK' END, CASE WHEN o7 / m >= 0.001 THEN o7 / m * 100 ELSE o7 END, CASE WHEN o7 / m >= 0.001 THEN '%' ELSE 'requests' END FROM t
UNION ALL SELECT 'wait', '1s tail', 'WARN', o1 / m * 100, '%' FROM t WHERE o1 / m >= 0.05
UNION ALL (SELECT 'wait', cls, 'OK', p95, 'ms' FROM p WHERE cls <> '(all)' AND p95 > 0 ORDER BY p95 DESC, {_ORDER} LIMIT 1)
UNION ALL SELECT 'errors', '5xx', CASE WHEN x / n >= 0.02 THEN 'BAD' WHEN x / n >= 0.005 THEN 'WARN' ELSE 'OK' END, x / n * 100, '%' FROM e WHERE x > 0
UNION ALL SELECT 'errors', 'server timeout', 'WARN', d / n * 100, '%' FROM e WHERE d / n >= 0.005
UNION ALL (SELECT 'mix', cls, 'OK', n / (SELECT n FROM e) * 100, '%' FROM k WHERE cls <> '(all)' ORDER BY n DESC, {_ORDER} LIMIT 1)
UNION ALL SELECT 'cache', '$upstream_cache_status', 'OK', ratio * 100, '%' FROM k WHERE cls = '(all)'
UNION ALL SELECT 'cache', cls, 'WARN', ratio * 100, '%' FROM k WHERE cls <> '(all)' AND judged >= 1000 AND ratio < 0.10
UNION ALL SELECT 'audience', 'log', 'OK', who / n * 100, '%' FROM e) """


@query(_FINDINGS + "SELECT * FROM f")
def finding_values(spark, sf_dir):
    """Each finding's level and the number it rests on."""
    return findings(spark, sf_dir).drop("message", "hint")


@query(_FINDINGS + "SELECT status, count(*) AS n, CAST(list_position(['OK', 'WARN', 'BAD', 'ERROR'], status) - 1 AS INT) AS severity FROM f GROUP BY status")
def finding_summary(spark, sf_dir):
    order = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return findings(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max(order[F.col("status")]).alias("severity"))


# Views altered so that the other rules come to hold: a sampled, a bursty and an unreadable log of a CDN.

_MISSED, _BURST = f"{BASE} + (ord % 50) * 2", f"{BASE} + CASE WHEN ord % 2 = 0 THEN 0 ELSE ord % 199 END"


def _altered(spark: SparkSession, sf_dir: str, case: str, **kw) -> dict:
    e = access_events(spark, sf_dir)
    n, none = e.count(), F.lit(None)
    if case == "unread":
        return build(e.where("false"), "cloudfront", "events", Counts(n, 0, n, 0), Options(**kw))
    every = {"sampled": 20, "bursty": 200}[case]
    left = e.where(F.col("ord") % every != 0)
    at = {"sampled": (F.col("ord") % 50) * 2, "bursty": F.when(F.col("ord") % 2 == 0, 0).otherwise(F.col("ord") % 199)}[case]
    left = left.withColumn("ts", F.timestamp_seconds(F.lit(BASE) + at)).withColumn("cache", F.lit("MISS") if case == "sampled" else none.cast("string"))
    left = left if case == "sampled" else left.withColumn("response_ns", none.cast("bigint"))
    kept = left.count()
    return build(left, "cloudfront", "events", Counts(n, kept, 0, n - kept), Options(**kw))


_ALTERED = f""", x AS (SELECT * REPLACE ({_MISSED} AS sec, 'MISS' AS cache) FROM b WHERE ord % 20 <> 0), y AS (SELECT * REPLACE ({_BURST} AS sec) FROM b WHERE ord % 200 <> 0),
xw AS (SELECT max(sec) - min(sec) + 1 AS w, count(DISTINCT sec) AS busy, count(*) AS n FROM x), xp AS (SELECT path, count(*) AS n, row_number() OVER (ORDER BY min(ord)) AS rn FROM x GROUP BY path),
ys AS (SELECT sec, count(*) AS n FROM y GROUP BY sec), yr AS (SELECT n, row_number() OVER (ORDER BY n) AS rn FROM ys), yw AS (SELECT max(sec) - min(sec) + 1 AS w, count(DISTINCT sec) AS busy FROM y),
yi AS (SELECT w - busy AS silent, {_RANKED.format("w")} AS idx FROM yw), yq AS (SELECT CASE WHEN idx < silent THEN 0 ELSE (SELECT n FROM yr WHERE rn = idx - silent + 1) END AS p95 FROM yi),
m AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (ord % 20 = 0) AS x, count(*) FILTER (ord % 200 = 0) AS y FROM a) """


@query(
    _ALTERED
    + """SELECT * FROM (
SELECT 'unread' AS kind, 'coverage' AS "check", 'log' AS target, 'ERROR' AS status, n AS value, 'lines' AS unit FROM m
UNION ALL SELECT 'sampled', 'coverage', 'log', CASE WHEN x / n >= 0.02 THEN 'ERROR' WHEN x / n >= 0.002 THEN 'WARN' ELSE 'OK' END, x / n * 100, '%' FROM m
UNION ALL SELECT 'bursty', 'coverage', 'log', CASE WHEN y / n >= 0.02 THEN 'ERROR' WHEN y / n >= 0.002 THEN 'WARN' ELSE 'OK' END, y / n * 100, '%' FROM m
UNION ALL SELECT 'sampled', 'coverage', 'paths', 'WARN', sum(n)::DOUBLE, 'requests' FROM xp WHERE rn > 50 HAVING sum(n) > 0
UNION ALL SELECT 'sampled', 'coverage', 'window', 'WARN', (w - busy) / w::DOUBLE * 100, '%' FROM xw WHERE n >= w AND (w - busy) / w::DOUBLE >= 0.20
UNION ALL SELECT 'bursty', 'rate', 'burstiness', 'WARN', (SELECT max(n) FROM ys) / p95::DOUBLE, '×' FROM yq WHERE p95 > 0 AND (SELECT max(n) FROM ys) / p95::DOUBLE >= 3
UNION ALL SELECT 'bursty', 'wait', 'all classes', 'OK', NULL, '' FROM m
UNION ALL SELECT 'bursty', 'cache', 'log', 'OK', NULL, '' FROM m
UNION ALL SELECT 'sampled', 'cache', cls, 'WARN', 0, '%' FROM x GROUP BY cls HAVING count(*) >= 1000
UNION ALL SELECT 'sampled', 'edge', 'origin share', 'OK', 100, '%' FROM m
UNION ALL SELECT 'bursty', 'edge', 'origin share', 'WARN', NULL, '' FROM m)"""
)
def finding_cases(spark, sf_dir):
    """The findings that the log as it is doesn't give."""
    wanted = {("coverage", "log"), ("coverage", "paths"), ("coverage", "window"), ("rate", "burstiness"), ("cache", "log"), ("edge", "origin share"), *(("cache", c) for c in DEFAULT.names())}
    rows = []
    for case in ("unread", "sampled", "bursty"):
        for f in _altered(spark, sf_dir, case, **({"max_paths": 50} if case == "sampled" else {}))["findings"]:
            if (f["check"], f["target"]) in wanted or (case == "bursty" and f["check"] == "wait"):
                rows.append((case, f["check"], f["target"], f["status"], f["value"], f["unit"]))
    return spark.createDataFrame(rows, "kind string, check string, target string, status string, value double, unit string")


@query(
    _ALTERED
    + """, k AS (SELECT cls, path, count(*) AS n, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, row_number() OVER (PARTITION BY cls ORDER BY min(ord)) AS rn FROM x GROUP BY cls, path),
fit AS (SELECT DISTINCT cls FROM k WHERE rn <= 50 AND ok / n::DOUBLE >= 0.95)
SELECT (SELECT sum(n) FROM xp WHERE rn > 50)::BIGINT AS dropped_paths, (w - busy)::BIGINT AS silent_seconds, w::BIGINT AS window_seconds, (SELECT count(*) FROM fit)::INT AS classes, 2000::BIGINT AS guillotine_ms, 1500::BIGINT AS max_p95_ms,
(SELECT floor(x / n * 1000 + 0.5) / 10 FROM m)::DOUBLE AS unreadable, 100.0::DOUBLE AS origin, (1 + (SELECT count(DISTINCT cls) FROM x) - (SELECT count(*) FROM fit) + 1 + 1 + 1)::INT AS warnings FROM xw"""
)
def profile_notes(spark, sf_dir):
    """What a profile of the sampled log warns of: its brake, classes without paths, silence, unreadable lines and the origin's share."""
    report = _altered(spark, sf_dir, "sampled", max_paths=50, pool_size=40)
    doc, said = P.build(report, P.ProfileOptions("https://edge.example.test", read_timeout_ms=2000, max_p95_ms=2000))
    number = lambda mark: float(re.search(r"([0-9.]+)%", next(w for w in said if mark in w))[1])
    silent, window = map(int, re.match(r"(\d+) of (\d+) ", doc["_measured"]["coverage_note"]).groups())
    said = [w for w in said if "left out, as" not in w]
    row = (doc["_measured"]["dropped_paths"], silent, window, len(doc["classes"]), doc["slo"]["guillotine_ms"], doc["slo"]["max_p95_ms"], number("unreadable"), number("origin saw"), len(said))
    return spark.createDataFrame([row], "dropped_paths long, silent_seconds long, window_seconds long, classes int, guillotine_ms long, max_p95_ms long, unreadable double, origin double, warnings int")


def _profile(spark: SparkSession, sf_dir: str) -> tuple[dict, list[str]]:
    return P.build(_report(spark, sf_dir, pool_size=40, pool_min_ok=0.5), P.ProfileOptions("https://edge.example.test"))


@query(_PATHS + f"SELECT cls, path, place FROM (SELECT *, {_RANK.format('n DESC')} FROM p WHERE cls <> '(all)' AND ok / n::DOUBLE >= 0.5) WHERE place <= 40")
def profile_pools(spark, sf_dir):
    """The pools of a profile, in their order; no path of the view looks like a token."""
    pools = _profile(spark, sf_dir)[0]["pools"]
    return spark.createDataFrame([(c, x, i) for c, p in pools.items() for i, x in enumerate(p, 1)], "cls string, path string, place int")


@query(_FINDINGS + f"""SELECT (SELECT cls FROM p WHERE cls <> '(all)' AND p95 > 0 ORDER BY p95 DESC, {_ORDER} LIMIT 1) AS brake_class, 5000::BIGINT AS max_p95_ms, 7000::BIGINT AS guillotine_ms, CAST(peak AS BIGINT) AS safe_peak_rps, n AS requests,
(SELECT string_agg(host, ',' ORDER BY host) FROM (SELECT host FROM a GROUP BY host ORDER BY count(*) DESC, host LIMIT 20)) AS allow_hosts FROM pk, w""")
def profile_limits(spark, sf_dir):
    """Brake, ceiling and hosts of a profile."""
    doc, _ = _profile(spark, sf_dir)
    row = (doc["slo"]["brake_class"], doc["slo"]["max_p95_ms"], doc["slo"]["guillotine_ms"], doc["safety"]["safe_peak_rps"], doc["_measured"]["requests"], ",".join(doc["safety"]["allow_hosts"]))
    return spark.createDataFrame([row], "brake_class string, max_p95_ms long, guillotine_ms long, safe_peak_rps long, requests long, allow_hosts string")


@query("SELECT cls AS name, floor(count(*) / (SELECT count(*) FROM a)::DOUBLE * 100 * 10 + 0.5) / 10 AS weight FROM b GROUP BY cls")
def profile_classes(spark, sf_dir):
    doc, _ = _profile(spark, sf_dir)
    return spark.createDataFrame([(c["name"], float(c["weight"])) for c in doc["classes"]], "name string, weight double")


@query(None)
def profile_json(spark, sf_dir):
    doc, said = _profile(spark, sf_dir)
    return spark.createDataFrame([(to_json(doc), len(said))], "profile string, warnings int")
