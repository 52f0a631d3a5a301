"""A load-test profile of a report: classes with measured weights, path pools, brake, ceiling and provenance.

The key names are the file format that the load generator reads; keys beginning with ``_`` are notes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from tidegauge.dialects import is_cdn
from tidegauge.functions.text import round1
from tidegauge.plans.findings import MALFORMED_WARN, seconds_text

#: Response headers that tell a cache's verdict, and what a hit looks like in them.
CACHE_HEADERS = (
    {"label": "proxy", "header": "X-Proxy-Cache", "hit": "HIT|STALE|UPDATING|REVALIDATED"},
    {"label": "cdn", "header": "X-Cache", "hit": "Hit"},
    {"label": "rfc9211", "header": "Cache-Status", "hit": "hit"},
)
_OPAQUE = re.compile(r"[A-Za-z0-9]{20,}")


class ProfileError(ValueError):
    """The profile can't be made; ``warnings`` tells what was noticed until then."""

    def __init__(self, message: str, warnings: Sequence[str] = ()):
        super().__init__(message)
        self.warnings = list(warnings)


@dataclass(frozen=True)
class ProfileOptions:
    base_url: str = ""
    name: str = ""
    description: str = ""
    target: str = "edge"
    host_header: str = ""
    bypass: str = ""
    read_timeout_ms: int = 7000
    max_p95_ms: int = 5000
    max_failed: float = 0.05
    safe_peak: int = 0
    allow_hosts: Sequence[str] = ()


def stamp(t: datetime | None) -> str:
    return "" if t is None else t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def one_place(share: float) -> str:
    return f"{share * 100:.1f}%"


def is_opaque(path: str) -> bool:
    """A segment looks like a token: 20 or more letters and digits, a quarter or more of them digits."""
    return any(_OPAQUE.fullmatch(s) and 4 * sum(c.isdigit() for c in s) >= len(s) for s in path.strip("/").split("/"))


def replayable(pool: list[dict]) -> tuple[list[str], int]:
    """Paths that may be replayed, and how many were left out."""
    good = [p["path"] for p in pool if p["path"].startswith("/") and not is_opaque(p["path"])]
    return good, len(pool) - len(good)


def build(r: dict, o: ProfileOptions) -> tuple[dict, list[str]]:
    """The profile document and its warnings."""
    if not o.base_url.strip():
        raise ProfileError("name the base URL the load is meant for; none is taken from the log")
    if not r["pools"]:
        raise ProfileError("the report holds no path pools: nothing in it may be replayed, or no pool size was asked for")
    said: list[str] = []
    brake_ms = o.max_p95_ms
    if brake_ms >= o.read_timeout_ms:
        brake_ms = o.read_timeout_ms * 3 // 4
        said.append(f"the p95 brake wasn't below the read timeout; it is now {seconds_text(brake_ms)}")
    classes, pools = [], {}
    for c in r["classes"]:
        paths, lost = replayable(r["pools"].get(c["name"], []))
        if not paths:
            said.append(f"class {c['name']} ({one_place(c['share'])} of requests) has no path fit for replay and is left out")
            continue
        if lost:
            said.append(f"class {c['name']}: {lost} path(s) left out, as not replayable or as carrying a token")
        pools[c["name"]] = paths
        note = f"{c['count']} requests, {one_place(c['share'])} of all, own peak {c['peak_per_sec']} req/s, {c['distinct_paths']} distinct paths"
        if c["latency"]:
            note += f", p95 {c['latency']['p95_ms']:.0f}ms of {r['latency_field']}"
        entry = {"name": c["name"], "label": c["label"], "weight": round1(c["share"] * 100), "pool": c["name"], "_note": note}
        classes.append(entry | ({"kind": "rsc"} if c["kind"] == "rsc" else {}))
    if not classes:
        raise ProfileError("no class is left with a path to replay", said)
    timed = [c for c in r["classes"] if c["name"] in pools and c["latency"] and c["latency"]["p95_ms"] > 0]
    if timed:
        brake = max(timed, key=lambda c: c["latency"]["p95_ms"])["name"]
    else:
        brake = classes[0]["name"]
        said.append(f"no class has a measured wait, so the brake is the first one, {brake}")
    hosts = sorted(o.allow_hosts or r["hosts"])
    if not hosts:
        said.append("the log names no host: fill safety.allow_hosts before a run")
    measured = {
        "by": r["tool"], "source": r["source"], "dialect": r["dialect"], "window_start": stamp(r["window"]["start"]), "window_end": stamp(r["window"]["end"]), "zone": r["zone"], "requests": r["counts"]["parsed"], "peak_per_sec": r["rate"]["peak_per_sec"],
        "peak_at": stamp(r["rate"]["peak_at"]), "mean_per_sec": round1(r["rate"]["mean_per_sec"]), "latency_field": r["latency_field"],
    }
    if r["latency"]:
        measured["latency_p95_ms"] = r["latency"]["p95_ms"]
    measured["audience_note"] = "clients are identified in the log, but weights are requests, not people" if r["audience"]["countable"] else "clients aren't identified in the log: weights are requests, and how many people made them is unknown"
    if r["window_seconds"] and r["silent_seconds"] * 5 >= r["window_seconds"]:
        measured["coverage_note"] = f"{r['silent_seconds']} of {r['window_seconds']} seconds hold no request: the log may be a sample, and so may these weights"
        said.append(measured["coverage_note"])
    if r["counts"]["malformed_share"] > MALFORMED_WARN:
        said.append(f"{one_place(r['counts']['malformed_share'])} of request lines were unreadable; weights are of the rest")
    if is_cdn(r["dialect"]):
        asked = one_place(1 - r["cache"]["hit_ratio"]) if r["cache"] else "an unknown part"
        measured["edge_note"] = f"measured above the cache: the origin was asked for {asked} of this mix, and the ceiling is what the edge survived"
        said.append(f"this mix is the audience's, as a CDN saw it; the origin saw {asked}")
    if r["paths_dropped"]:
        measured["dropped_paths"] = r["paths_dropped"]
    target = {"base_url": o.base_url} | ({"host_header": o.host_header} if o.host_header else {}) | ({"bypass": o.bypass} if o.bypass else {})
    doc = {
        "_note": "Measured from an access log. Keys with a leading underscore are notes. Measure again after a release: asset names change.",
        "name": o.name or "measured", "description": o.description or f"request mix of {r['source']} ({r['dialect']}), {stamp(r['window']['start'])} to {stamp(r['window']['end'])}",
        "_measured": measured, "targets": {"default": o.target or "edge", "list": {o.target or "edge": target}}, "classes": classes, "pools": pools, "cache_headers": [dict(h) for h in CACHE_HEADERS],
        "slo": {"max_failed_rate": o.max_failed, "max_p95_ms": brake_ms, "guillotine_ms": o.read_timeout_ms, "brake_class": brake, "_note": f"guillotine_ms is the read timeout as given ({seconds_text(o.read_timeout_ms)}); brake_class is the slowest class at p95"},
        "safety": {"safe_peak_rps": o.safe_peak if o.safe_peak > 0 else r["rate"]["peak_per_sec"], "allow_hosts": hosts, "_note": "safe_peak_rps is the busiest second measured, a level that was survived"},
    }
    return doc, said
