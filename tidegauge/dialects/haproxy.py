"""HAProxy HTTP log: fields found by shape around the accept date and the five timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.dialects.event import finish, held
from tidegauge.functions.text import empty_null, integer, is_host, millis, target, tokens, trimmed, unquote

LATENCY_FIELD = "Tr (wait for the server's response)"
_DATE = r"\[(\d\d/[A-Za-z]{3}/\d{4}:\d{1,2}:\d\d:\d\d(?:\.\d+)?)\]"
_TIMERS = r"^[+-]?\d+(/[+-]?\d+){4}$"


def _instant(text: Column, tz: str) -> Column:
    """Read with up to microseconds, in the log's zone."""
    plain = F.substring_index(text, ".", 1)
    micros = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)$", 1), 1, 6), 6, "0")
    both = F.concat(plain, F.lit("."), micros)
    return F.to_utc_timestamp(F.try_to_timestamp(both, F.lit("dd/MMM/yyyy:H:mm:ss.SSSSSS")), tz)


def parse(lines: DataFrame, tz: str = "UTC", xff_capture: int = 0) -> DataFrame:
    at = lambda off: F.get("__f", F.col("__t") + off)
    dates = F.filter(F.regexp_extract_all("__l", F.lit(_DATE), F.lit(1)), lambda x: _instant(x, tz).isNotNull())
    d = held(lines, __l=trimmed(F.coalesce("value", F.lit(""))))
    d = held(d, __d=F.get(dates, F.lit(0)))
    mark = F.concat(F.lit("["), F.col("__d"), F.lit("]"))
    d = held(d, __at=F.instr("__l", mark), __size=F.length(mark))
    d = held(d, __f=tokens(F.substring("__l", F.col("__at") + F.col("__size"), F.length("__l"))), __words=F.filter(F.split(F.regexp_extract("__l", r'"([^"]*)"[^"]*$', 1), r"\s+"), lambda w: w != ""))
    d = held(d, __t=F.array_position(F.transform("__f", lambda x: x.rlike(_TIMERS)), F.lit(True)) - 1, __r=target(F.col("__words")))
    caps = F.transform(F.filter("__f", lambda x: x.startswith("{") & (F.length(x) > 1)), lambda x: F.split(unquote(x), r"\|"))
    d = held(d, __x=F.split(at(0), "/"), __code=integer(at(1)).try_cast("int"), __caps=caps)
    code = F.col("__code")
    status = F.when(F.col("__d").isNull(), "skipped").when((F.coalesce("__t", F.lit(-1)) < 0) | code.isNull() | (F.coalesce(F.col("__r.path"), F.lit("")) == ""), "malformed").otherwise("parsed")
    behind = F.when(F.col("__t") >= 2, at(-1))
    last = F.element_at(F.split(trimmed(F.substring("__l", F.lit(1), F.col("__at") - 1)), r"\s+"), -1)
    known = F.coalesce(last.contains(":") & ~last.endswith(":"), F.lit(False))
    if xff_capture > 0:
        slot = lambda c: F.coalesce(~trimmed(F.get(c, F.lit(xff_capture - 1))).isin("", "-"), F.lit(False))
        known = known | F.exists("__caps", slot)
    host = F.lower(trimmed(F.get(F.filter(F.flatten("__caps"), is_host), F.lit(0))))
    state = at(5)
    return finish(
        d, lines, status,
        ts=_instant(F.col("__d"), tz), method=empty_null(F.col("__r.method")), path=F.col("__r.path"), query=F.col("__r.query"), host=host, status=code, bytes=F.coalesce(integer(at(2)), F.lit(0)),
        frontend=F.when(F.col("__t") >= 2, at(-2)), backend=empty_null(F.substring_index(behind, "/", 1)), server=F.when(behind.contains("/"), empty_null(F.regexp_extract(behind, r"^[^/]*/(.*)$", 1))),
        wait_ns=millis(F.get("__x", F.lit(1))), response_ns=millis(F.get("__x", F.lit(3))), total_ns=millis(F.get("__x", F.lit(4))),
        term_state=F.when((F.octet_length(state) == 4) & (state != "----"), state), client_identity=known,
    )
