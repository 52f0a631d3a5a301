"""What the two JSON dialects share: a strict reading of one object a line, and values by key.

A line is one JSON object and nothing else: text after it, single quotes, NaN and bare control characters make it
malformed. Keys match in any case. Of a repeated key every value has to be of a kind that fits, and the last one that
isn't null counts. Only within a nested object do repeated keys make a line malformed, unless the session sets
spark.sql.variant.allowDuplicateKeys.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.dialects.event import held
from tidegauge.functions.text import trimmed

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _folded(key: Column) -> Column:
    """One spelling for all that differ by case: the long s is an s in capitals, and no other case of it is lost."""
    return F.replace(F.lower(key), F.lit("ſ"), F.lit("s"))


def _sealed(line: Column) -> Column:
    """The line as the first of two elements; the second holds the line's hash, which no line can hold itself.

    So a line that closes the array early, or adds elements to it, is told from one that is an object and no more.
    """
    text = F.concat(F.lit("["), line, F.lit(',{"":'), F.xxhash64(line).cast("string"), F.lit("}]"))
    return F.from_json(text, "array<map<string,variant>>", _STRICT)


def opened(lines: DataFrame, texts: Iterable[str], wholes: Iterable[str] = (), numbers: Iterable[str] = (), loose: Iterable[str] = ()) -> DataFrame:
    """With __l, the trimmed line, __ok, whether it is one object whose values fit, and the value of each key as text.

    Texts are strings, wholes integers of 64 bits, numbers any numbers; loose ones are of any kind, and where they
    are empty or a dash they count as null.
    """
    wanted = (((*texts,), ("STRING",)), ((*wholes,), ("BIGINT",)), ((*numbers,), ("BIGINT", "DOUBLE", "DECIMAL")), ((*loose,), ("",)))
    loose, keys = wanted[3][0], [k for names, _ in wanted for k in names]
    d = held(lines, __l=trimmed(F.coalesce("value", F.lit(""))))
    d = held(d, __pair=F.when(is_object(), _sealed(F.col("__l"))))
    whole_line = (F.size("__pair") == 2) & (F.try_variant_get(F.get("__pair", F.lit(1))[""], "$", "bigint") == F.xxhash64("__l"))
    folded = F.transform(F.map_entries(F.get("__pair", F.lit(0))), lambda e: F.struct(_folded(e.key).alias("k"), e.value.alias("v")))
    known = F.filter(folded, lambda e: e.k.isin(*(k.lower() for k in keys)))
    told = F.transform(known, lambda e: F.struct(e.k.alias("k"), F.schema_of_variant(e.v).alias("kind"), F.try_variant_get(e.v, "$", "string").alias("t")))
    d = held(d, __all=F.when(whole_line, F.filter(told, lambda m: m.kind != "VOID")))

    def fits(m: Column) -> Column:
        return reduce(or_, [m.k.isin(*(k.lower() for k in names)) & reduce(or_, [m.kind.startswith(x) for x in kinds]) for names, kinds in wanted if names])

    silent = lambda m: m.k.isin(*(k.lower() for k in loose)) & trimmed(m.t).isin("", "-")
    last = F.reverse(F.filter("__all", lambda m: ~silent(m)) if loose else F.col("__all"))
    d = held(d, __ok=F.coalesce(F.forall("__all", fits), F.lit(False)), __last=last)
    d = held(d, __k=F.col("__last.k"), __t=F.col("__last.t"))
    return held(d, **{f"__t_{k}": F.get("__t", F.array_position("__k", F.lit(k.lower())).cast("int") - 1) for k in keys})


def is_object() -> Column:
    return F.col("__l").startswith("{")


def value(key: str) -> Column:
    """A key's last value as text, with a number's digits kept; null where there is none."""
    return F.col(f"`__t_{key}`")


def text(key: str) -> Column:
    """The same, empty where there is none."""
    return F.coalesce(value(key), F.lit(""))
