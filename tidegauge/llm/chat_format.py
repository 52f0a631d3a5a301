"""Chat formatting by a declarative template and a finite-state machine over roles. DataFrame functions only.

A template names, for each role, the marks before and after a turn, whether the turn's text is trained on, and the
states (previous roles; "begin" before the first turn) it may follow. Turns become segments (text, loss): mark,
text, mark. Inside texts the escape sign and the two signs that every mark begins with are replaced by two-sign
codes, so no text can hold a mark, and ``parse`` gives the turns back exactly.

Turns are ordered by turn number, then role, then text; nulls come first. A null text or role is empty. Repeated
rows are repeated turns. A role without an entry uses the template's marks for other roles. A conversation that
breaks turn order is formatted all the same, with valid = false and the first turn at fault. A null conversation id
is a conversation of its own. Other columns are ignored. A conversation is one result row, so its turns meet in one
task; its length is the only bound.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks begin with "<" or "[" and hold no escape sign. "end" lists the states a conversation may stop in.
TEMPLATE: dict = {
    "roles": {
        "system": {"before": "<<SYS>>\n", "after": "\n<</SYS>>\n", "loss": False, "follows": ["begin"]},
        "user": {"before": "[INST] ", "after": " [/INST]", "loss": False, "follows": ["begin", "system", "assistant"]},
        "assistant": {"before": "<s>", "after": "</s>", "loss": True, "follows": ["user"]},
    },
    "other": {"before": "<|", "named": "|>", "after": "<|end|>", "loss": False, "follows": []},
    "end": ["assistant"],
}
#: Escape codes, in the order they are applied.
CODES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))


def escape(c: Column) -> Column:
    for plain, code in CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _choose(role: Column, template: Mapping, key: str, other) -> Column:
    out = None
    for name, spec in template["roles"].items():
        out = F.when(role == name, F.lit(spec[key])) if out is None else out.when(role == name, F.lit(spec[key]))
    return out.otherwise(other)


def segments(role: Column, text: Column, template: Mapping) -> Column:
    """The three segments of a turn."""
    other = template["other"]
    before = _choose(role, template, "before", F.concat(F.lit(other["before"]), escape(role), F.lit(other["named"])))
    after = _choose(role, template, "after", F.lit(other["after"]))
    loss = _choose(role, template, "loss", F.lit(other["loss"]))
    return F.array(F.struct(before.alias("text"), F.lit(False).alias("loss")), F.struct(escape(text).alias("text"), loss.alias("loss")), F.struct(after.alias("text"), F.lit(False).alias("loss")))


def format_conversations(turns: DataFrame, template: Mapping = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segments, formatted, valid, fault (0-based position of the first turn out of order, or the number of turns for a bad end)."""
    legal = [f"{p}\n{name}" for name, spec in template["roles"].items() for p in spec["follows"]]
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    state = F.transform("t", lambda x, i: F.concat(F.when(i == 0, F.lit("begin")).otherwise(F.get(F.col("t"), i - 1)["role"]), F.lit("\n"), x["role"]))
    wrong = F.filter(F.transform(state, lambda s, i: F.when(~s.isin(legal), i)), lambda i: i.isNotNull())
    bad_end = ~F.element_at("t", -1)["role"].isin(list(template["end"]))
    fault = F.coalesce(F.get(wrong, F.lit(0)), F.when(bad_end, F.size("t")))
    out = whole.select("conv_id", F.flatten(F.transform("t", lambda x: segments(x["role"], x["text"], template))).alias("segments"), fault.alias("fault"))
    return out.select("conv_id", "segments", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"), F.col("fault").isNull().alias("valid"), "fault")


def parse(formatted: Column, template: Mapping = TEMPLATE) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    body, q, other = r"[^<\[]*", re.escape, template["other"]
    turn = "|".join([q(s["before"]) + body + q(s["after"]) for s in template["roles"].values()] + [q(other["before"]) + r"[^|<\[]*" + q(other["named"]) + body + q(other["after"])])

    def read(x: Column) -> Column:
        out = None
        for name, s in template["roles"].items():
            inner = F.substring(x, F.lit(len(s["before"]) + 1), F.length(x) - len(s["before"]) - len(s["after"]))
            pair = F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"))
            hit = x.startswith(F.lit(s["before"]))
            out = F.when(hit, pair) if out is None else out.when(hit, pair)
        head = F.instr(x, other["named"])
        name = F.substring(x, F.lit(len(other["before"]) + 1), head - 1 - len(other["before"]))
        rest = F.substring(x, head + len(other["named"]), F.length(x) - head - len(other["named"]) + 1 - len(other["after"]))
        return out.otherwise(F.struct(unescape(name).alias("role"), unescape(rest).alias("text")))

    return F.transform(F.regexp_extract_all(formatted, F.lit(turn), F.lit(0)), read)


def read_back(output: DataFrame, template: Mapping = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, fault, from formatted output."""
    turns = output.select("*", parse(F.col("formatted"), template).alias("turns"), F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))).alias("trained"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("fault").cast("long").alias("fault"))
