"""Cheapest edits that give a conversation lawful turns: an optional system turn, then user and assistant by turns.

A conversation's rows, in order, and the states of the turn order make a layered graph: from a row and a state one may
keep the row (if its role's initial may follow), rerole it, delete it, or insert a turn before it. Costs are small whole
numbers, so Dial's bucket queue (a ring of as many buckets as the dearest arc costs, and one) settles each node's distance
to the end without a heap. The distances are recorded; then a walk from the start along tight arcs (those whose cost is
the difference of their ends' distances) takes the least letter at each node, which is the least of all cheapest audits:
a letter leads to one node only. Letters: D delete, I insert, K keep, R rerole.

Rows are ordered by turn (nulls first), then role, then text. Null roles and texts are one space. Each row has at most
one fault, the first of: blank (no sign but ASCII white space), duplicate (role and text seen earlier in the conversation),
truncated (the last such sign isn't one of ``.!?``). Blank and duplicate rows have to be deleted; a truncated row that
stays costs 3 more. A role that is empty has no initial and can't be kept. Repeated rows are repeated turns, and so
duplicates. Rows with a null id are one conversation. Other columns are ignored. An empty table gives no rows.

Spark deals rows by conversation and sorts them; a task streams its sorted rows and holds one conversation at a time, as
compact columns and 24 bytes a row for the distances. Audit and repaired text follow a conversation from its first to its
last row, so its length is the one bound.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import released, table

#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; those a conversation may end in.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Where an initial leads from each state, and the role that may be made up in each state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
MADE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LAWFUL = {"su", "ua", "au"}
WHITE = r"\x20\x09-\x0D"
#: Conversations of at most so many rows whose solution a worker remembers by their codes, and how many of them.
REMEMBERED_ROWS, REMEMBERED = 64, 50_000


def arcs(code: str, state: int) -> list[tuple[str, int, int]]:
    """letter, cost, next state of the edits that use up a row. Codes: ``x`` must go, else the initial, in capitals where truncated."""
    out = [("D", DELETE, state)]
    if code == "x":
        return out
    more = CUT_OFF if code.isupper() else 0
    nxt = STEPS.get(code.lower(), {}).get(state)
    if nxt is not None:
        out.append(("K", more, nxt))
    return [*out, ("R", REROLE + more, STEPS[MADE[state][0]][state])]


#: The same arcs backwards, by code and state arrived at: (state left, cost).
_BACK = {c: [[(p, cost) for p in range(4) for _, cost, q in arcs(c, p) if q == to] for to in range(4)] for c in "xsuaoSUAO"}
_BACK_INSERT = [[p for p in range(4) if STEPS[MADE[p][0]][p] == to] for to in range(4)]
_RING = max(cost for by_state in _BACK.values() for found in by_state for _, cost in found) + 1


def distances(codes: str) -> list[int]:
    """The cost to the end from each node (row, state), at 4 * row + state; -1 where none is reached."""
    dist = [-1] * (4 * len(codes) + 4)
    ring: list[list[int]] = [[] for _ in range(_RING)]
    ring[0] = [4 * len(codes) + q for q in ENDS]
    now, idle = 0, 0
    while idle < _RING:
        bucket = ring[now % _RING]
        idle = 0 if bucket else idle + 1
        while bucket:  # arcs without cost add to it
            node = bucket.pop()
            if dist[node] >= 0:
                continue
            dist[node] = now
            row, state = node >> 2, node & 3
            for p in _BACK_INSERT[state]:
                if dist[4 * row + p] < 0:
                    ring[(now + INSERT) % _RING].append(4 * row + p)
            if row:
                for p, cost in _BACK[codes[row - 1]][state]:
                    if dist[4 * row - 4 + p] < 0:
                        ring[(now + cost) % _RING].append(4 * row - 4 + p)
        now += 1
    return dist


def walk(codes: str, dist: list[int]) -> str:
    """The least audit among the cheapest."""
    row, state, audit = 0, START, []
    while row < len(codes) or dist[4 * row + state]:
        left = dist[4 * row + state]
        options = [(letter, cost, row + 1, q) for letter, cost, q in arcs(codes[row], state)] if row < len(codes) else []
        options.append(("I", INSERT, row, STEPS[MADE[state][0]][state]))
        letter, _, row, state = min(o for o in options if dist[4 * o[2] + o[3]] >= 0 and o[1] + dist[4 * o[2] + o[3]] == left)
        audit.append(letter)
    return "".join(audit)


def _solve(codes: str) -> tuple[int, str]:
    dist = distances(codes)
    return dist[START], walk(codes, dist)


_remembered = functools.lru_cache(REMEMBERED)(_solve)


def solve(codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation's codes (see ``arcs``)."""
    return _remembered(codes) if len(codes) <= REMEMBERED_ROWS else _solve(codes)


def apply_audit(audit: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The repaired roles and texts."""
    out_roles, out_texts, row, state = [], [], 0, START
    for letter in audit:
        if letter != "D":
            role = roles[row] if letter == "K" else MADE[state]
            out_roles.append(role)
            out_texts.append("" if letter == "I" else texts[row])
            state = STEPS[role[0]][state]
        row += letter != "I"
    return out_roles, out_texts


_OUT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>"


def _repaired(conv: int | None, turns: list, roles: list[str], texts: list[str], faults: list[int]) -> tuple:
    """The result of one conversation; ``faults``: 1 blank, 2 truncated."""
    codes, seen, count = [], set(), [0, 0, 0]
    for role, text, fault in zip(roles, texts, faults):
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if fault == 1:
            count[0] += 1
            codes.append("x")
        elif (role, text) in seen:
            count[1] += 1
            codes.append("x")
        else:
            count[2] += fault == 2
            codes.append(initial.upper() if fault == 2 else initial)
        seen.add((role, text))
    illegal = sum(a[:1] + b[:1] not in LAWFUL for a, b in zip(roles, roles[1:]))
    known = {t for t in turns if t is not None}
    cost, audit = solve("".join(codes))
    return (conv, max(known) - min(known) + 1 - len(known) if known else 0, *count, illegal, cost, audit, *apply_audit(audit, roles, texts))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return table(dict(zip(_OUT.names, zip(*rows))), _OUT)


@released
def _repair(batches: Iterator[pa.RecordBatch], together: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Sorted rows to conversations, some ``together`` characters a batch. A row without place (lost) only names its conversation."""
    conv, held, out, size = None, None, [], 0
    for batch in batches:
        for key, lost, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or key != conv:
                if held is not None:
                    out.append(_repaired(conv, *held))
                    size += 1000 + sum(map(len, held[2]))
                    if size > together:
                        yield _batch(out)
                        out, size = [], 0
                conv, held = key, ([], [], [], [])
            if not lost:
                for part, value in zip(held, row):
                    part.append(value)
    if held is not None:
        out.append(_repaired(conv, *held))
    if out:
        yield _batch(out)


def _said(c: Column) -> Column:
    return F.make_valid_utf8(F.coalesce(c.cast("string"), F.lit(" ")))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, lost: rows spoilt by a rule on their id and turn; a dropped row stays as a lost one."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    text, role = _said(F.col(text_col)), _said(F.col(role_col))
    spoilt = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    base = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), spoilt.alias("text"), (kind == 0).alias("lost"), F.when(kind == 3, 2).otherwise(1).alias("__n"))
    return base.withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).drop("__n")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lost_col: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts: each conversation repaired.

    Rows whose ``lost_col`` is true don't count; a conversation of such rows alone is an empty one.
    """
    text = _said(F.col(text_col))
    fault = F.when(~text.rlike(f"[^{WHITE}]"), 1).when(~text.rlike(rf"[.!?][{WHITE}]*\z"), 2).otherwise(0)
    lost = F.coalesce(F.col(lost_col), F.lit(False)) if lost_col else F.lit(False)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), lost.alias("lost"), F.col(turn_col).cast("long").alias("turn"), _said(F.col(role_col)).alias("role"), text.alias("text"), fault.alias("fault"))
    ordered = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(_repair, SCHEMA)


def repair_report(turns: DataFrame, **kw) -> DataFrame:
    """``repair`` with repaired_sha256 of the repaired turns (``role:text``, newline-joined) in their place."""
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    return repair(turns, **kw).withColumn("repaired_sha256", F.sha2(said.cast("binary"), 256)).drop("roles", "texts")
