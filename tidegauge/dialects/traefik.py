"""Traefik JSON access log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.dialects.event import finish, held
from tidegauge.dialects.json_lines import is_object, opened, text
from tidegauge.functions.text import after_mark, before_mark, empty_null, number

LATENCY_FIELD = "OriginDuration (wait for the service)"
_RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"
_TEXTS = ("StartUTC", "StartLocal", "RequestMethod", "RequestPath", "RequestHost", "ServiceName", "RouterName", "ClientHost", "request_Cache-Status")
_WHOLE = ("DownstreamStatus", "OriginStatus", "DownstreamContentSize")
_NUMBERS = ("Duration", "OriginDuration")


def parse(lines: DataFrame, tz: str = "UTC", xff_capture: int = 0) -> DataFrame:
    d = opened(lines, _TEXTS, _WHOLE, _NUMBERS)
    instant = lambda k: F.when(text(k).rlike(_RFC3339), text(k).try_cast("timestamp"))
    d = held(d, __ts=F.coalesce(instant("StartUTC"), instant("StartLocal")), __p=text("RequestPath"))
    idle = (F.col("__p") == "") & (text("RequestMethod") == "")
    status = F.when(~is_object(), "skipped").when(~F.col("__ok"), "malformed").when(idle, "skipped").when(F.col("__ts").isNull() | (before_mark(F.col("__p")) == ""), "malformed").otherwise("parsed")
    nanos = lambda k: F.when(number(text(k)) > 0, number(text(k)).cast("bigint"))
    code = F.coalesce(text("DownstreamStatus").try_cast("int"), F.lit(0))
    return finish(
        d, lines, status,
        ts=F.col("__ts"), method=empty_null(text("RequestMethod")), path=before_mark(F.col("__p")), query=after_mark(F.col("__p")), host=empty_null(F.lower(text("RequestHost"))),
        status=F.when(code != 0, code).otherwise(F.coalesce(text("OriginStatus").try_cast("int"), F.lit(0))), bytes=F.coalesce(text("DownstreamContentSize").try_cast("bigint"), F.lit(0)),
        frontend=empty_null(text("RouterName")), backend=empty_null(text("ServiceName")), response_ns=nanos("OriginDuration"), total_ns=nanos("Duration"), cache=empty_null(F.upper(text("request_Cache-Status"))), client_identity=text("ClientHost") != "",
    )
