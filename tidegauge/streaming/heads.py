"""CloudFront headers of logs that are still growing: a file's last header is its state.

A file's lines reach the same state whatever trigger they come in, so a line is read by the header before it even if that
came days earlier. A header that no line has used or renewed within the time to live is let go, as of a file that was
rotated away; lines that come after that are malformed, as are those of a file without a header.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from tidegauge.dialects.cloudfront import AT, places

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds after which an unused header is let go.
TTL_MS = 7 * 24 * 3_600_000
#: Bytes of a file's lines in a trigger that stay in memory; the rest waits in the task's scratch folder until all headers are known.
HELD_BYTES = 16 << 20
_LINES = pa.schema([("file", pa.string()), ("line_block", pa.int64()), ("line_no", pa.int64()), ("value", pa.string())])
SCHEMA = f"file string, line_block long, line_no long, value string, {AT} array<int>"


class HeaderCarry(StatefulProcessor):
    """Lines of one file, whose order within a trigger is their block and number, with the places of the header before them.

    They come in no order, so a trigger's lines are passed twice, for the headers and to give each its places; of the lines
    a task holds a batch and ``HELD_BYTES``.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", f"{AT} array<int>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        heads: list[tuple[tuple, list[int]]] = []
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with SpooledTemporaryFile(HELD_BYTES, dir=folder if os.path.isdir(folder) else None) as held:
            with pa.ipc.new_stream(held, _LINES) as out:
                for lines in rows:
                    batch = pa.RecordBatch.from_pandas(lines, _LINES, preserve_index=False)
                    out.write_batch(batch)
                    marked = lines["value"].fillna("").str.strip(" \t\n\x0b\f\r").str.slice(0, 8).str.lower() == "#fields:"
                    where = _where(batch) if marked.any() else []
                    heads += [(where[i], found) for i in marked.to_numpy().nonzero()[0].tolist() if (found := places(lines["value"].iloc[i]))]
            heads.sort()
            at = [int(x) for x in self.head.get()[0]] if self.head.exists() else None
            known = [at, *(found for _, found in heads)]
            if known[-1] is not None:
                self.head.update((known[-1],))  # every use renews it
            held.seek(0)
            order = [where for where, _ in heads]
            for batch in pa.ipc.open_stream(held):
                lines = batch.to_pandas()
                lines[AT] = pd.Series([known[bisect_left(order, where)] for where in _where(batch)], index=lines.index, dtype=object)
                yield lines

    def close(self) -> None:
        pass


def _where(batch: pa.RecordBatch) -> list[tuple]:
    """Block and number of each line; null comes last."""
    last = np.iinfo(np.int64).max
    return list(zip(*(batch.column(c).fill_null(last).to_pylist() for c in ("line_block", "line_no"))))


def with_heads_stream(lines: DataFrame, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """A stream of lines (file, line_block, line_no, value) with the column of places that the CloudFront parser reads.

    With a time to live Spark runs triggers without data, too, so over a source that tells its end by empty triggers
    (its file source under ``availableNow``) such a query doesn't end; ``ttl_ms`` None keeps headers for good, and it ends.
    """
    conf = lines.sparkSession.conf
    if not conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return lines.select("file", "line_block", "line_no", "value").groupBy("file").transformWithStateInPandas(HeaderCarry(ttl_ms), SCHEMA, "Append", "None" if ttl_ms is None else "ProcessingTime")
