"""Tokenising, splitting and guarded number reading, as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a quoted, bracketed or braced group (an unclosed one runs to the end) or a run of anything else.
TOKEN = r'"[^"]*(?:"|$)|\[[^\]]*(?:\]|$)|\{[^}]*(?:\}|$)|[^ \t"\[{]+'
INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def empty_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def unquote(c: Column) -> Column:
    """One layer of surrounding quotes, brackets or braces taken off."""
    wrapped = (c.startswith('"') & c.endswith('"')) | (c.startswith("[") & c.endswith("]")) | (c.startswith("{") & c.endswith("}"))
    return F.when((F.length(c) >= 2) & wrapped, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def before_mark(c: Column) -> Column:
    """What stands before the first question mark."""
    return F.substring_index(c, "?", 1)


def after_mark(c: Column) -> Column:
    """What stands after the first question mark, empty without one."""
    at = F.instr(c, "?")
    return F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise("")


def target(words: Column) -> Column:
    """struct<method,path,query> of a request line's words; a lone word is a path."""
    many = F.size(words) > 1
    raw = F.coalesce(F.get(words, F.when(many, 1).otherwise(0)), F.lit(""))
    return F.struct(F.when(many, F.get(words, F.lit(0))).otherwise("").alias("method"), before_mark(raw).alias("path"), after_mark(raw).alias("query"))


def integer(c: Column) -> Column:
    """A whole decimal number, or null; blanks and type suffixes aren't numbers."""
    return F.when(c.rlike(INTEGER), c.try_cast("bigint"))


def number(c: Column) -> Column:
    """A decimal number, or null; infinities, hex and blanks aren't numbers."""
    return F.when(c.rlike(FLOAT), c.try_cast("double"))


def whole_or_float(c: Column) -> Column:
    """An integer, or a float cut to one."""
    return F.coalesce(integer(c), number(c).try_cast("bigint"))


def millis(c: Column) -> Column:
    """Nanoseconds of a non-negative whole number of milliseconds."""
    n = integer(c)
    return F.when(n >= 0, n * 1_000_000)


def seconds_rounded(c: Column) -> Column:
    n = number(c)
    return F.when(n >= 0, F.round(n * 1e9).cast("bigint"))


def seconds_cut(c: Column) -> Column:
    n = number(c)
    return F.when(n >= 0, (n * 1e9).cast("bigint"))


def is_host(c: Column) -> Column:
    """Looks like a host name, with or without a port: dotted, at most 253 bytes, only letters, digits, dot, dash, underscore."""
    s = trimmed(c)
    name = F.regexp_replace(s, r":[^:]*$", "")
    return F.coalesce((s != "") & (s != "-") & (F.octet_length(s) <= 253) & ~s.rlike(r"[ /\\@]") & name.contains(".") & name.rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False))


def has_param(query: Column, name: str) -> Column:
    """The raw query carries the named parameter, with or without a value."""
    return F.coalesce(F.exists(F.split(query, "[&;]"), lambda x: ((x == name) & (x != "")) | x.startswith(name + "=")), F.lit(False))


def looks_secret(path: Column) -> Column:
    """Some segment of 20 bytes or more is letters and digits only, at least a quarter of them digits."""
    digits = lambda s: F.length(s) - F.length(F.regexp_replace(s, "[0-9]", ""))
    return F.coalesce(F.exists(F.split(F.btrim(path, F.lit("/")), "/"), lambda s: (F.octet_length(s) >= 20) & s.rlike("^[A-Za-z0-9]+$") & (4 * digits(s) >= F.length(s))), F.lit(False))


def status_class(status: Column) -> Column:
    return F.when(status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("other")


def round1(x: float) -> float:
    return int(x * 10 + 0.5) / 10
