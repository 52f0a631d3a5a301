"""Request classes: ordered first-match rules compiled to one Column.

A few terms become a chain of conditions in the plan; a set of more than ``CHAIN_TERMS`` is looked up in hash tables,
with the same result, as such a chain costs every request a test a term and takes long to compile.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.text import has_param
from tidegauge.operators import rule_index

#: Terms (of paths and queries, over all rules) that a chain of conditions may have.
CHAIN_TERMS = 150


@dataclass(frozen=True)
class Rule:
    """A class and what claims a request for it: any path or query condition, if the method (when given) fits."""

    name: str
    label: str = ""
    kind: str = ""
    path_prefixes: tuple[str, ...] = ()
    path_suffixes: tuple[str, ...] = ()
    path_contains: tuple[str, ...] = ()
    query_params: tuple[str, ...] = ()
    methods: tuple[str, ...] = ()

    def condition(self) -> Column:
        path = F.lower(F.coalesce("path", F.lit("")))
        any_of = [path.startswith(x.lower()) for x in self.path_prefixes] + [path.endswith(x.lower()) for x in self.path_suffixes] + [path.contains(x.lower()) for x in self.path_contains] + [has_param(F.col("query"), x) for x in self.query_params]
        hit = reduce(or_, any_of, F.lit(False)) if any_of else F.lit(False)
        if self.methods:
            hit = F.lower(F.coalesce("method", F.lit(""))).isin([m.lower() for m in self.methods]) & hit
        return hit


@dataclass(frozen=True)
class ClassSet:
    rules: tuple[Rule, ...] = ()
    fallback: str = "doc"

    def column(self) -> Column:
        """The class of a row, by its path, query and method."""
        terms = sum(len(r.path_prefixes) + len(r.path_suffixes) + len(r.path_contains) + len(r.query_params) for r in self.rules)
        return self.chain() if terms <= CHAIN_TERMS else rule_index.column(self)

    def chain(self) -> Column:
        """The same as conditions in the rules' order."""
        out = None
        for r in self.rules:
            out = F.when(r.condition(), F.lit(r.name)) if out is None else out.when(r.condition(), F.lit(r.name))
        return F.lit(self.fallback) if out is None else out.otherwise(self.fallback)

    def names(self) -> list[str]:
        """Every class, in declaration order, the fallback last."""
        return [*(r.name for r in self.rules), self.fallback]

    def kind(self, name: str) -> str:
        return next((r.kind for r in self.rules if r.name == name and r.kind), "plain")

    def label(self, name: str) -> str:
        return next((r.label for r in self.rules if r.name == name and r.label), name)


#: What a rule of a class set may hold: field, type, and whether it is a list of texts.
_RULE_FIELDS = {"name": False, "label": False, "kind": False, "path_prefixes": True, "path_suffixes": True, "path_contains": True, "query_params": True, "methods": True}
_KINDS = ("", "plain", "rsc")


def _faults(fallback: object, rules: object) -> list[str]:
    """Everything that keeps a class set from sorting requests into distinct classes."""
    if not isinstance(rules, list) or not all(isinstance(r, dict) for r in rules):
        return ["rules: a list of objects is wanted"]
    out = [] if isinstance(fallback, str) and fallback.strip() else ["fallback: a class name is wanted"]
    names = [fallback, *(r.get("name") for r in rules)]
    for i, r in enumerate(rules, 1):
        for field, is_list in _RULE_FIELDS.items():
            value = r.get(field)
            texts = value if is_list and isinstance(value, list) else [value]
            if value is not None and (is_list != isinstance(value, list) or not all(isinstance(x, str) for x in texts)):
                out.append(f"rules[{i}].{field}: {'texts in a list are' if is_list else 'a text is'} wanted")
        if not str(names[i] or "").strip():
            out.append(f"rules[{i}].name: missing")
        elif names[i] in names[:i]:
            out.append(f"rules[{i}].name: {names[i]!r} twice")
        if (r.get("kind") or "") not in _KINDS:
            out.append(f"rules[{i}].kind: one of {_KINDS[1:]} is wanted")
        if not any(r.get(f) for f, is_list in _RULE_FIELDS.items() if is_list and f != "methods"):
            out.append(f"rules[{i}]: nothing about path or query, so it takes every request")
    return out


def load(text: str) -> ClassSet:
    """A class set of its JSON, refused with all its faults at once."""
    raw = json.loads(text)
    fallback, rules = (raw.get("fallback"), raw.get("rules") or []) if isinstance(raw, dict) else (None, None)
    if found := _faults(fallback, rules):
        raise ValueError("class set: " + "; ".join(found))
    made = [{f: tuple(r.get(f) or ()) if is_list else r.get(f) or "" for f, is_list in _RULE_FIELDS.items()} for r in rules]
    return ClassSet(tuple(Rule(**m) for m in made), fallback)


#: The built-in classes, in matching order.
DEFAULT = ClassSet(
    (
        Rule("rsc_nav", "client-side navigation", "rsc", query_params=("_rsc",)),
        Rule("media", "media segments", path_suffixes=(".m3u8", ".mpd", ".ts", ".m4s", ".mp4", ".cmfv", ".cmfa", ".vtt")),
        Rule("static", "static assets", path_suffixes=(".js", ".mjs", ".css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".avif", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".json", ".txt", ".xml", ".webmanifest")),
        Rule("search", "search", path_contains=("/search", "/cerca")),
        Rule("api", "API calls", path_prefixes=("/api/", "/v1/", "/v2/", "/graphql", "/_next/data/")),
    ),
    "doc",
)
