"""Findings: what the measurements mean, each with its level and the number it rests on."""

from __future__ import annotations

from tidegauge.dialects import is_cdn

SEVERITY = {"OK": 0, "WARN": 1, "BAD": 2, "ERROR": 3}

#: Shares and ratios at which a level is reached.
MALFORMED_WARN, MALFORMED_ERROR = 0.002, 0.02
SILENT_MEAN, SILENT_WARN = 1.0, 0.20
BURSTY = 3.0
TIMEOUT_BAD = 0.001
SLOW_WARN = 0.05
FIVEXX_WARN, FIVEXX_BAD = 0.005, 0.02
TERMINATION_WARN = 0.005
COLD_REQUESTS, COLD_RATIO = 1000, 0.10


def percent(share: float) -> str:
    if share == 0:
        return "0%"
    digits = 4 if share < 0.0001 else 2 if share < 0.01 else 1
    return f"{share * 100:.{digits}f}%"


def level(value: float, *steps: tuple[float, str]) -> str:
    """The last level whose bound the value reaches."""
    out = "OK"
    for bound, name in steps:
        if value >= bound:
            out = name
    return out


def seconds_text(ms: float) -> str:
    return f"{ms / 1000:g}s"


def _coverage(r: dict) -> list[tuple]:
    c, out = r["counts"], []
    if s := c["malformed_share"]:
        out.append(("log", level(s, (MALFORMED_WARN, "WARN"), (MALFORMED_ERROR, "ERROR")), f"{percent(s)} of what looks like requests was unreadable ({c['malformed']} of {c['malformed'] + c['parsed']})", s * 100, "%", "the format has fields this dialect doesn't expect; all shares are of the readable part"))
    if r["paths_dropped"]:
        out.append(("paths", "WARN", f"{r['paths_dropped']} requests went to paths beyond the path cap", float(r["paths_dropped"]), "requests", "path lists and pools lack them: raise the cap or shorten the window"))
    if r["window_seconds"] and r["rate"]["mean_per_sec"] >= SILENT_MEAN and (s := r["silent_seconds"] / r["window_seconds"]) >= SILENT_WARN:
        out.append(("window", "WARN", f"{r['silent_seconds']} of {r['window_seconds']} seconds ({percent(s)}) hold no request", s * 100, "%", "at this mean rate whole seconds don't fall silent by chance: the log is probably sampled"))
    return [("coverage", *x) for x in out]


def _rate(r: dict) -> list[tuple]:
    q, out = r["rate"], []
    if q["peak_per_sec"] > 0:
        out.append(("peak second", "OK", f"the busiest second, {q['peak_at']:%H:%M:%S}, had {q['peak_per_sec']} requests (mean {q['mean_per_sec']:.1f}, p95 {q['p95_per_sec']:.0f})", float(q["peak_per_sec"]), "req/s", "capacity has to hold for this second, whatever the mean"))
        if q["p95_per_sec"] > 0 and (x := q["peak_per_sec"] / q["p95_per_sec"]) >= BURSTY:
            out.append(("burstiness", "WARN", f"the peak is {x:.1f} times the p95 second", x, "×", "arrivals come in bursts: test with the peak, an average hides it"))
    return [("rate", *x) for x in out]


def _waiting(r: dict, timeout_ms: int) -> list[tuple]:
    lat, out = r["latency"], []
    if lat is None:
        out.append(("all classes", "OK", "no timing in this log, so nothing is known of waits", None, "", "log a response or request time to learn which tier fills up first"))
    else:
        hint = "seen from the edge: answers from cache and from the origin are in one distribution" if is_cdn(r["dialect"]) else "time spent waiting on the tier behind; it rises with that tier's queue"
        out.append(("all classes", "OK", f"{r['latency_field']}: p50 {lat['p50_ms']:.0f}ms, p95 {lat['p95_ms']:.0f}ms, p99 {lat['p99_ms']:.0f}ms, max {lat['max_ms']:.0f}ms", lat["p95_ms"], "ms", hint))
        over = next((t for t in reversed(lat["tails"]) if t["over_ms"] == timeout_ms), None)
        limit = seconds_text(timeout_ms)
        if over and over["share"] >= TIMEOUT_BAD:
            out.append(("read timeout", "BAD", f"{percent(over['share'])} of waits ({over['count']}) passed the {limit} read timeout", over["share"] * 100, "%", "beyond it the proxy answers 504 by itself: visitors saw errors"))
        elif over and over["count"]:
            out.append(("read timeout", "WARN", f"{over['count']} waits ({percent(over['share'])}) passed the {limit} read timeout", float(over["count"]), "requests", "the tail has reached the timeout; a higher peak goes past it"))
        elif over:
            out.append(("read timeout", "OK", f"no wait passed the {limit} read timeout", 0.0, "requests", "there is margin at this load: keep this log as a baseline"))
        for t in lat["tails"]:
            if t["over_ms"] == 1000 and t["share"] >= SLOW_WARN:
                out.append(("1s tail", "WARN", f"{percent(t['share'])} of waits ({t['count']}) took more than a second", t["share"] * 100, "%", "so deep a queue means no idle worker behind at the peak"))
    slow = max((c for c in r["classes"] if c["latency"] and c["latency"]["p95_ms"] > 0), key=lambda c: c["latency"]["p95_ms"], default=None)
    if slow:
        out.append((slow["name"], "OK", f"{slow['name']} is the slowest class at p95 ({slow['latency']['p95_ms']:.0f}ms)", slow["latency"]["p95_ms"], "ms", "stop a load test by this class: it gives way first"))
    return [("wait", *x) for x in out]


def _errors(r: dict) -> list[tuple]:
    out = []
    if s := next((x for x in r["statuses"] if x["label"] == "5xx"), None):
        most = f", mostly {r['top_5xx'][0]['path']} ({r['top_5xx'][0]['fivexx']})" if r["top_5xx"] else ""
        out.append(("5xx", level(s["share"], (FIVEXX_WARN, "WARN"), (FIVEXX_BAD, "BAD")), f"{percent(s['share'])} of answers were 5xx ({s['count']}){most}", s["share"] * 100, "%", "errors of a single path are rather a fault of the application than missing capacity"))
    for t in r["termination"]:
        if t["label"].startswith("sD") and t["share"] >= TERMINATION_WARN:
            out.append(("server timeout", "WARN", f"{percent(t['share'])} of requests ({t['count']}) ended in {t['label']}: the server was given up on", t["share"] * 100, "%", "the proxy stopped waiting for the server, which is a sign of missing capacity"))
    return [("errors", *x) for x in out]


def _mix(r: dict) -> list[tuple]:
    if not r["classes"]:
        return []
    c = max(r["classes"], key=lambda x: x["count"])
    return [("mix", c["name"], "OK", f"{c['name']} is the largest class: {percent(c['share'])} of requests ({c['count']}), {c['peak_per_sec']} in its own busiest second", c["share"] * 100, "%", "classes peak at different seconds; a flat list of addresses doesn't load a site like this")]


def _cache(r: dict) -> list[tuple]:
    c = r["cache"]
    if c is None:
        return [("cache", "log", "OK", "no cache verdict in this log, so the hit ratio is unknown", None, "", "unknown isn't zero: log the cache's verdict before judging it")]
    out = [("cache", c["field"], "OK", f"{percent(c['hit_ratio'])} of judged answers came without the tier behind ({c['hits']} of {c['measured']})", c["hit_ratio"] * 100, "%", "those requests cost the tier behind nothing")]
    for k in r["classes"]:
        if k["cache"] and k["cache"]["measured"] >= COLD_REQUESTS and k["cache"]["hit_ratio"] < COLD_RATIO:
            out.append(("cache", k["name"], "WARN", f"{k['name']} comes from cache {percent(k['cache']['hit_ratio'])} of the time ({k['cache']['measured']} judged)", k["cache"]["hit_ratio"] * 100, "%", "a class this cold is mostly never looked up: see its cache rules and response headers"))
    return out


def _edge(r: dict) -> list[tuple]:
    if not is_cdn(r["dialect"]):
        return []
    if c := r["cache"]:
        miss = 1 - c["hit_ratio"]
        return [("edge", "origin share", "OK", f"a CDN log: the origin was asked for {percent(miss)} of judged requests ({c['measured'] - c['hits']})", miss * 100, "%", "mix and peak are the audience's; size the origin for the misses alone")]
    return [("edge", "origin share", "WARN", "a CDN log without cache verdicts: what reached the origin is unknown", None, "", "add the cache result to the log's fields")]


def _audience(r: dict) -> list[tuple]:
    a = r["audience"]
    said = ("nearly every request carries a client identifier", "addresses can be counted, but an address isn't a person") if a["countable"] else ("too few requests carry a client identifier to count people", "the address may be captured but not printed by the log format")
    return [("audience", "log", "OK", f"{said[0]} ({percent(a['identity_share'])})", a["identity_share"] * 100, "%", said[1])]


def worst_first(found: list[dict]) -> list[dict]:
    return sorted(found, key=lambda f: (-SEVERITY[f["status"]], f["check"], f["target"]))


def evaluate(r: dict, timeout_ms: int) -> list[dict]:
    """All findings of a report, worst first."""
    if r["counts"]["parsed"] == 0:
        rows = [("coverage", "log", "ERROR", f"none of {r['counts']['lines']} lines was read as a request", float(r["counts"]["lines"]), "lines", "the dialect doesn't fit, or this is no access log: no number here means anything")]
    else:
        rows = [*_coverage(r), *_rate(r), *_waiting(r, timeout_ms), *_errors(r), *_mix(r), *_cache(r), *_edge(r), *_audience(r)]
    return worst_first([dict(zip(("check", "target", "status", "message", "value", "unit", "hint"), x)) for x in rows])


def summarize(found: list[dict]) -> dict[str, int]:
    return {s: sum(f["status"] == s for f in found) for s in SEVERITY}


def worst(found: list[dict]) -> str:
    return max((f["status"] for f in found), key=SEVERITY.__getitem__, default="OK")


def at_least(status: str, threshold: str) -> bool:
    return SEVERITY[status] >= SEVERITY[threshold]


FINDING_SCHEMA = "check string, target string, status string, message string, value double, unit string, hint string"
