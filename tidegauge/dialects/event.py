"""The event every dialect gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_COLUMNS = {
    "ts": "timestamp", "method": "string", "path": "string", "query": "string", "host": "string", "status": "int", "bytes": "bigint", "frontend": "string", "backend": "string", "server": "string",
    "wait_ns": "bigint", "response_ns": "bigint", "total_ns": "bigint", "cache": "string", "term_state": "string", "client_identity": "boolean",
}


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """With the columns added behind a generated row, so that what uses one of them several times computes it once."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__h")
    return df.select("*", row).select(*df.columns, *[F.col(f"__h.{n}").alias(n) for n in columns])


def finish(df: DataFrame, lines: DataFrame, outcome: Column, /, **fields: Column) -> DataFrame:
    """The line columns, parse_status, the event columns, null unless the line was parsed, and latency_source."""
    # One generated row a line: a filter on parse_status then stays above the parse and doesn't repeat it.
    event = F.struct(outcome.alias("s"), *[(fields[c] if c in fields else F.lit(None)).cast(t).alias(c) for c, t in EVENT_COLUMNS.items()])
    out = df.select(*lines.columns, F.explode(F.array(event)).alias("__e"))
    ok = F.col("__e.s") == "parsed"
    out = out.select(*lines.columns, F.col("__e.s").alias("parse_status"), *[F.when(ok, F.col(f"__e.{c}")).alias(c) for c in EVENT_COLUMNS])
    return out.withColumn("latency_source", latency_source())


def latency_ns() -> Column:
    return F.coalesce("response_ns", "total_ns")


def latency_source() -> Column:
    """Which timer a row's wait came from."""
    return F.when(F.col("response_ns").isNotNull(), "response").when(F.col("total_ns").isNotNull(), "total")
