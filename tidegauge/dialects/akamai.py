"""Akamai DataStream 2 JSON lines; every scalar may be a string or a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.dialects.event import finish, held
from tidegauge.dialects.json_lines import is_object, opened, text, value
from tidegauge.functions.text import after_mark, before_mark, empty_null, number, trimmed, whole_or_float

LATENCY_FIELD = "turnAroundTimeMSec (wait seen by the edge)"
_OTHERS = ("reqTimeSec", "statusCode", "cacheStatus", "turnAroundTimeMSec", "totalBytes")
_TEXTS = ("reqMethod", "reqPath", "reqHost", "queryStr", "cliIP", "xForwardedFor")


def loose(key: str) -> Column:
    return trimmed(value(key))


def epoch(raw: Column) -> Column:
    """Unix seconds with a fraction, read digit by digit; null unless positive."""
    secs, frac = F.regexp_extract(raw, r"^\+?(\d+)(?:\.(\d*))?$", 1), F.regexp_extract(raw, r"^\+?(\d+)(?:\.(\d*))?$", 2)
    whole = F.nullif(secs, F.lit("")).try_cast("bigint")
    return F.when((whole > 0) & (whole < 253_402_300_800), F.timestamp_micros(whole * 1_000_000 + F.rpad(F.substring(frac, 1, 6), 6, "0").cast("bigint")))


def parse(lines: DataFrame, tz: str = "UTC", xff_capture: int = 0) -> DataFrame:
    d = opened(lines, _TEXTS, loose=_OTHERS)
    d = held(d, __p=text("reqPath"), __ts=epoch(loose("reqTimeSec")), __code=whole_or_float(loose("statusCode")).try_cast("int"), __wait=number(loose("turnAroundTimeMSec")), __hit=whole_or_float(loose("cacheStatus")))
    code = F.col("__code")
    idle = (F.col("__p") == "") & (text("reqMethod") == "")
    bad = F.col("__ts").isNull() | (F.col("__p") == "") | (loose("statusCode").isNotNull() & code.isNull())
    status = F.when(~is_object(), "skipped").when(~F.col("__ok"), "malformed").when(idle, "skipped").when(bad, "malformed").otherwise("parsed")
    wait, verdict = F.col("__wait"), F.col("__hit")
    here = lambda k: ~text(k).isin("", "-")
    return finish(
        d, lines, status,
        ts=F.col("__ts"), method=empty_null(text("reqMethod")), path=before_mark(F.col("__p")), query=F.coalesce(empty_null(text("queryStr")), after_mark(F.col("__p"))), host=empty_null(F.lower(text("reqHost"))),
        status=F.coalesce(code, F.lit(0)), bytes=F.coalesce(whole_or_float(loose("totalBytes")), F.lit(0)), response_ns=F.when(wait >= 0, (wait * 1e6).cast("bigint")),
        cache=F.when(verdict == 1, "HIT").when(verdict == 0, "MISS"), client_identity=here("cliIP") | here("xForwardedFor"),
    )
