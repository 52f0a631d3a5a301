"""Large class sets: all terms of all rules in hash tables, so that a request's cost doesn't grow with the rules.

A path is looked up once for each length of prefix and of suffix that some rule has, and once for each of its bytes for
what it may contain. Texts are compared as bytes, lowered by Spark before, just as the rules written as conditions are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tidegauge.operators.classes import ClassSet

#: So many first bytes, at most, tell which terms a path may contain from a place on.
HEAD = 8


class RuleIndex:
    """Finds the first rule that claims a request; rules are numbered in their order."""

    def __init__(self, classes: ClassSet) -> None:
        self.names = [*(r.name for r in classes.rules), classes.fallback]
        self.methods = [frozenset(m.lower().encode() for m in r.methods) for r in classes.rules]
        self.starts, self.ends, inside = ({} for _ in range(3))
        self.params: dict[bytes, list[int]] = defaultdict(list)
        for i, r in enumerate(classes.rules):
            for by_length, terms in ((self.starts, r.path_prefixes), (self.ends, r.path_suffixes), (inside, r.path_contains)):
                for term in {x.lower().encode() for x in terms}:
                    by_length.setdefault(len(term), {}).setdefault(term, []).append(i)
            for name in {x.encode() for x in r.query_params}:
                self.params[name].append(i)
        self.anywhere = inside.pop(0, {}).get(b"", [])  # the empty term is in every path
        self.head = min([HEAD, *inside])
        self.inside: dict[bytes, dict[int, dict[bytes, list[int]]]] = {}
        for n, terms in inside.items():
            for term, rules in terms.items():
                self.inside.setdefault(term[: self.head], {}).setdefault(n, {})[term] = rules

    def _claims(self, found: Iterable[int]) -> list[int]:
        """Rules in order, none behind the first that takes any method, as none of those can be a request's first."""
        out = []
        for i in sorted(set(found)):
            out.append(i)
            if not self.methods[i]:
                break
        return out

    def of_path(self, path: bytes) -> list[int]:
        size = len(path)
        found = list(self.anywhere)
        for n, terms in self.starts.items():
            found += terms.get(path[:n], ())
        for n, terms in self.ends.items():
            if n <= size:
                found += terms.get(path[size - n :], ())
        if self.inside:
            for at in range(size - self.head + 1):
                for n, terms in self.inside.get(path[at : at + self.head], {}).items():
                    found += terms.get(path[at : at + n], ())
        return self._claims(found)

    def of_query(self, query: bytes | None) -> list[int]:
        if query is None or not self.params:
            return []
        return self._claims(i for part in query.replace(b";", b"&").split(b"&") for name in _param_names(part) for i in self.params.get(name, ()))

    def first(self, path: list[int], query: list[int], method: bytes) -> str:
        fits = (i for i in (*path, *query) if not self.methods[i] or method in self.methods[i])
        return self.names[min(fits, default=-1)]

    def classify(self, paths: Iterable[bytes], queries: Iterable[bytes | None], methods: Iterable[bytes]) -> Iterator[str]:
        """Classes of a batch's requests; each of its distinct paths and queries is looked up once."""
        by_path: dict[bytes, list[int]] = {}
        by_query: dict[bytes | None, list[int]] = {}
        for p, q, m in zip(paths, queries, methods):
            if p not in by_path:
                by_path[p] = self.of_path(p)
            if q not in by_query:
                by_query[q] = self.of_query(q)
            yield self.first(by_path[p], by_query[q], m)


def _param_names(part: bytes) -> Iterator[bytes]:
    """The names a part of a query answers to: all of it, and what stands before any of its equals signs."""
    if part:
        yield part
    at = part.find(b"=")
    while at >= 0:
        yield part[:at]
        at = part.find(b"=", at + 1)


def column(classes: ClassSet) -> Column:
    """The class of a row, by its path, query and method, looked up in tables."""
    index = RuleIndex(classes)

    @F.pandas_udf("string")
    def looked_up(path: pd.Series, query: pd.Series, method: pd.Series) -> pd.Series:
        return pd.Series(list(index.classify(path, query, method)), dtype=object)

    lowered = lambda c: F.lower(F.coalesce(c, F.lit(""))).cast("binary")
    return looked_up(lowered("path"), F.col("query").cast("binary"), lowered("method"))
