"""CloudFront standard log: tab-separated, columns named by the latest #Fields line of the same file.

Which header names a line's columns is a scan carried over the lines of a file, in two levels: within a block of lines,
which one task reads in order, the last header goes from line to line; over the blocks of a file, each takes the last
header of those before it, from a table of a row a block. A line carries the places of its columns and nothing else of
the headers. A file starts without a header, whatever came before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.dialects.event import finish, held
from tidegauge.functions.text import after_mark, before_mark, empty_null, integer, seconds_rounded, trimmed

LATENCY_FIELD = "time-to-first-byte (wait for the first byte), else time-taken"
#: Blocks whose carried headers are sent to all tasks; more of them meet their lines by a shuffle.
FEW_BLOCKS = 50_000
#: Lines that come in no order are brought into ranges of 2**CUT_BITS line numbers, each of which counts as a block.
CUT_BITS = 14
#: What tells blocks apart; the cut is 0 for lines that come in order.
_BLOCK = ("file_idx", "line_block", "__cut")
#: The column of a line's places: for each of NAMES its last column in the header, -1 where it isn't there; null without one.
AT = "__at"
NAMES = ("date", "time", "x-edge-location", "sc-bytes", "c-ip", "cs-method", "cs(host)", "cs-uri-stem", "sc-status", "cs-uri-query", "x-edge-result-type", "x-host-header", "time-taken", "time-to-first-byte", "x-forwarded-for")

#: A header line, and white space as parsers see it.
_MARK = "(?i)^[ \\t\\n\\x0b\\f\\r]*#fields:"
_WHITE = re.compile("[ \t\n\x0b\f\r]+")


def places(header: str) -> list[int] | None:
    """The last column of each of NAMES in a #Fields line, None if it names nothing."""
    names = [n for n in _WHITE.split(header.strip(" \t\n\x0b\f\r")[8:].lower()) if n]
    last = {n: i for i, n in enumerate(names)}
    return [last.get(n, -1) for n in NAMES] if names else None


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[int, list[int]]]:
    """First rows of a batch's runs of one file and block, and the places of its header rows."""
    file, block, cut = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    begins = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (block[1:] != block[:-1]) | (cut[1:] != cut[:-1])]) if batch.num_rows else np.array([], np.int64)
    value = batch.column(3).view(pa.binary())
    found = pc.fill_null(pc.match_substring_regex(value, _MARK), False).to_numpy(zero_copy_only=False)
    heads = {int(i): places(value[int(i)].as_py().decode("utf-8", "replace")) for i in np.flatnonzero(found)}
    return begins, {i: at for i, at in heads.items() if at}


def _key(batch: pa.RecordBatch, row: int) -> tuple:
    return tuple(batch.column(i)[row].as_py() for i in range(3))


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line of blocks in order with the places of the last header before it in its block."""
    now, at = None, None
    for batch in batches:
        n, (begins, heads) = batch.num_rows, _runs(batch)
        if not n:
            continue
        # Where the places change: behind a header, and at a block's first line, which only goes on with what its own block had.
        marks = {i + 1: found for i, found in heads.items() if i + 1 < n}
        marks |= {int(i): None for i in begins}
        marks[0] = at if _key(batch, 0) == now else None
        steps = np.array(sorted(marks))
        known = [marks[i] for i in steps.tolist()]
        owner = np.searchsorted(steps, np.arange(n), side="right") - 1
        now, at = _key(batch, n - 1), heads[n - 1] if n - 1 in heads else known[owner[-1]]
        has = np.array([k is not None for k in known])[owner]
        flat = np.array([k or [0] * len(NAMES) for k in known], np.int32)[owner[has]].ravel()
        offsets = np.r_[0, np.cumsum(has)] * len(NAMES)
        column = pa.ListArray.from_arrays(pa.array(offsets[:-1].tolist() + [int(offsets[-1])], pa.int32(), mask=np.r_[~has, False]), pa.array(flat, pa.int32()))
        yield batch.append_column(AT, column)


def _last_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file_idx, line_block, cut, at of each block of lines in order: its last header's places, null without one."""
    last: dict[tuple, list[int] | None] = {}
    for batch in batches:
        begins, heads = _runs(batch)
        for i in begins.tolist():
            last.setdefault(_key(batch, i))
        for i, at in heads.items():
            last[_key(batch, i)] = at
    files, blocks, cuts = zip(*last) if last else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(blocks, pa.int64()), pa.array(cuts, pa.int64()), pa.array(list(last.values()), pa.list_(pa.int32()))], names=[*_BLOCK, "at"])


def with_heads(lines: DataFrame, ordered: bool = False, one_block: bool = False) -> DataFrame:
    """Lines with the column ``AT``.

    ``ordered``: the lines of a block lie in one partition and in order, as files are read; else they are brought there,
    a long block in ranges of its lines.
    ``one_block``: each file is one block, so nothing is carried from one to the next, and the lines are read once.
    """
    names = ["file_idx", "line_block", "line_no", "value", *[c for c in lines.columns if c not in ("file_idx", "line_block", "line_no", "value")]]
    cut = F.lit(0).cast("long") if ordered or one_block else F.coalesce(F.shiftright(F.col("line_no").cast("long"), CUT_BITS), F.lit(-(2**63)))
    lines = lines.withColumn("__cut", cut)
    if not ordered:
        lines = lines.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "line_no")
    base = lines.select(*_BLOCK, "value", *[c for c in names if c not in (*_BLOCK, "value")])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    own = base.mapInArrow(_carried, f"{types}, {AT} array<int>")
    if one_block:
        return own.select(*names, AT)
    before = Window.partitionBy("file_idx").orderBy("line_block", "__cut").rowsBetween(Window.unboundedPreceding, -1)
    carry = base.select(*_BLOCK, "value").mapInArrow(_last_heads, "file_idx int, line_block long, __cut long, at array<int>")
    carry = carry.select(*_BLOCK, F.last("at", ignorenulls=True).over(before).alias("__carry")).where("__carry is not null")
    few = carry.limit(FEW_BLOCKS + 1).collect()  # a row a block
    if len(few) <= FEW_BLOCKS:
        carry = F.broadcast(lines.sparkSession.createDataFrame(few, carry.schema))
    return own.join(carry, list(_BLOCK), "left").withColumn(AT, F.coalesce(AT, "__carry")).select(*names, AT)


def parse(lines: DataFrame, tz: str = "UTC", xff_capture: int = 0) -> DataFrame:
    """Of lines with or without ``AT``, which is dropped."""
    d = lines if AT in lines.columns else with_heads(lines)
    lines = d.drop(AT)
    d = held(d, __l=trimmed(F.coalesce("value", F.lit(""))), __c=F.transform(F.split("value", "\t"), trimmed))

    def field(place: int) -> Column:
        i = F.get("__at", F.lit(place))
        v = F.coalesce(F.when(i >= 0, F.get("__c", i)), F.lit(""))
        return F.when(v != "-", v).otherwise("")

    d = held(d, **{f"__v{i}": field(i) for i in range(len(NAMES))})
    get = lambda name: F.col(f"__v{NAMES.index(name)}")
    d = held(d, __stamp=F.concat_ws(" ", get("date"), get("time")))
    stamp = F.col("__stamp")
    d = held(d, __ts=F.when(stamp.rlike(r"^\d{4}-\d\d-\d\d \d{1,2}:\d\d:\d\d(\.\d+)?$"), stamp.try_cast("timestamp")), __p=get("cs-uri-stem"), __q=get("cs-uri-query"), __code=integer(get("sc-status")).try_cast("int"))
    code = F.col("__code")
    skipped = (F.col("__l") == "") | F.col("__l").startswith("#")
    status = F.when(skipped, "skipped").when(F.col("__at").isNull() | F.col("__ts").isNull() | (F.col("__p") == "") | code.isNull(), "malformed").otherwise("parsed")
    bare = F.col("__q") == ""
    return finish(
        d, lines, status,
        ts=F.col("__ts"), method=empty_null(get("cs-method")), path=F.when(bare, before_mark(F.col("__p"))).otherwise(F.col("__p")), query=F.when(bare, after_mark(F.col("__p"))).otherwise(F.col("__q")),
        host=empty_null(F.lower(F.coalesce(empty_null(get("x-host-header")), get("cs(host)")))), status=code, bytes=F.coalesce(integer(get("sc-bytes")), F.lit(0)), frontend=empty_null(get("x-edge-location")),
        response_ns=seconds_rounded(get("time-to-first-byte")), total_ns=seconds_rounded(get("time-taken")), cache=empty_null(F.upper(get("x-edge-result-type"))), client_identity=(get("c-ip") != "") | (get("x-forwarded-for") != ""),
    )
