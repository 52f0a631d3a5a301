"""nginx combined log, with a cache verdict and a request time recognised by shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.dialects.event import finish, held
from tidegauge.functions.text import empty_null, integer, number, seconds_cut, target, tokens, trimmed, unquote

LATENCY_FIELD = "$request_time (whole request)"
#: The cache verdicts nginx writes.
VERDICTS = ("HIT", "MISS", "BYPASS", "EXPIRED", "STALE", "UPDATING", "REVALIDATED", "SCARCE")


def parse(lines: DataFrame, tz: str = "UTC", xff_capture: int = 0) -> DataFrame:
    first = lambda arr, ch, after: F.array_position(F.transform(arr, lambda x, i: (i > after) & x.startswith(ch) & (F.length(x) > 1)), F.lit(True)) - 1
    d = held(lines, __l=trimmed(F.coalesce("value", F.lit(""))))
    d = held(d, __f=tokens(F.col("__l")))
    d = held(d, __d=first(F.col("__f"), "[", F.lit(-1)))
    d = held(d, __raw=F.get("__f", F.col("__d")))
    d = held(d, __stamp=unquote(F.col("__raw")), __q=first(F.col("__f"), '"', F.col("__d")))
    stamp = F.col("__stamp")
    shaped = stamp.rlike(r"^\d\d/[A-Za-z]{3}/\d{4}:\d{1,2}:\d\d:\d\d [+-]\d{4}$")
    d = held(d, __ts=F.when((F.col("__d") >= 0) & shaped, F.try_to_timestamp(stamp, F.lit("dd/MMM/yyyy:H:mm:ss Z"))), __said=F.get("__f", F.col("__q")), __third=F.get("__f", F.col("__q") + 1))
    d = held(d, __words=F.filter(F.split(unquote(F.col("__said")), r"\s+"), lambda w: w != ""), __code=integer(F.col("__third")).try_cast("int"))
    d = held(d, __r=target(F.col("__words")))
    code = F.col("__code")
    skipped = (F.col("__l") == "") | F.col("__l").startswith("#") | (F.size("__f") < 7) | F.col("__ts").isNull()
    malformed = (F.col("__q") < 0) | (F.col("__q") + 2 >= F.size("__f")) | (F.coalesce(F.col("__r.path"), F.lit("")) == "") | code.isNull()
    status = F.when(skipped, "skipped").when(F.coalesce(malformed, F.lit(True)), "malformed").otherwise("parsed")
    d = held(d, __tail=F.slice("__f", F.greatest(F.col("__q") + 4, F.lit(1)).cast("int"), F.greatest(F.size("__f"), F.lit(0))))
    tail = F.col("__tail")
    grouped = lambda x: x.startswith('"') | x.startswith("[")
    word = lambda x: F.upper(F.when(grouped(x), trimmed(unquote(x))).otherwise(x))
    cache = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(tail, word), lambda v: v.isin(*VERDICTS))), -1)
    times = F.filter(tail, lambda x: ~grouped(x) & F.coalesce(number(x) >= 0, F.lit(False)))
    return finish(
        d, lines, status,
        ts=F.col("__ts"), method=empty_null(F.col("__r.method")), path=F.col("__r.path"), query=F.col("__r.query"), status=code, bytes=F.coalesce(integer(F.get("__f", F.col("__q") + 2)), F.lit(0)),
        total_ns=seconds_cut(F.get(times, F.lit(0))), cache=cache, client_identity=F.get("__f", F.lit(0)) != "-",
    )
