"""Five access-log dialects: a lines table to a table of parsed events.

``parse(lines, dialect, ...)`` adds parse_status (parsed, skipped, malformed) and the event columns to every line.
Absent values are null, never zero; durations are nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidegauge.dialects import akamai, cloudfront, haproxy, nginx, traefik
from tidegauge.dialects.event import EVENT_COLUMNS

_MODULES = {"haproxy": haproxy, "nginx": nginx, "traefik": traefik, "cloudfront": cloudfront, "akamai": akamai}
DIALECTS = tuple(_MODULES)
CDN = {"cloudfront", "akamai"}
#: What a dialect's wait measures; it goes with every wait reported.
LATENCY_FIELD = {n: m.LATENCY_FIELD for n, m in _MODULES.items()}
#: Where a dialect's cache verdict comes from.
CACHE_FIELD = {"haproxy": "cache verdict", "nginx": "$upstream_cache_status", "traefik": "Cache-Status", "cloudfront": "x-edge-result-type", "akamai": "cacheStatus"}


def register(name: str, module, cache_field: str = "cache verdict", cdn: bool = False) -> None:
    """Add a parser of your own: anything with ``parse(lines, tz, xff_capture)`` and ``LATENCY_FIELD``.

    It takes part in detection like the others. The names of the five built-in dialects can't be taken.
    """
    key = name.lower()
    if key in DIALECTS:
        raise ValueError(f"{key} is a built-in dialect")
    _MODULES[key], LATENCY_FIELD[key], CACHE_FIELD[key] = module, module.LATENCY_FIELD, cache_field
    (CDN.add if cdn else CDN.discard)(key)


def known() -> tuple[str, ...]:
    """All dialects, registered ones last."""
    return tuple(_MODULES)


def by_name(name: str):
    if name.lower() not in _MODULES:
        raise ValueError(f"unknown dialect {name!r}; known are {', '.join(known())}")
    return _MODULES[name.lower()]


def is_cdn(name: str) -> bool:
    return name.lower() in CDN


def parse(lines: DataFrame, dialect: str, tz: str = "UTC", xff_capture: int = 0) -> DataFrame:
    return by_name(dialect).parse(lines, tz=tz, xff_capture=xff_capture)


__all__ = ["CACHE_FIELD", "CDN", "DIALECTS", "EVENT_COLUMNS", "LATENCY_FIELD", "by_name", "is_cdn", "known", "parse", "register"]
