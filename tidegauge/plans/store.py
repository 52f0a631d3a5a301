"""Stored cells: each run counts its own lines, and a report adds up the counts of runs without reading a line again.

A run (a day, a machine's log) is a folder ``run=<name>`` of cells, written once: a run that is there already is left as it
is, so a job that is repeated changes nothing, and one that broke off is written anew. A run counts as there by the mark
that Spark's committer leaves last. Beside its cells a run keeps what they depend on (dialect, classes, zone, capture);
only runs alike in that are added up. Runs come in the order of their names: what was seen first in an earlier run was
seen first. All counts, peaks, percentiles and lists are those of the lines read at once: sums, minima and maxima of
cells lose nothing.

A window of time has to be set when a run is stored; cells can't be cut afterwards.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators import metrics as M
from tidegauge.plans.report import Options, cells_of, of_cells, parsed_lines

#: Runs that one report may add up: their number goes before a line's place, which has 108 bits of some 126.
MOST_RUNS = 1 << 17
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
_RUN = re.compile(r"run=(.+)$")


class StoreError(ValueError):
    """Cells that can't be stored or added up."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def runs(spark: SparkSession, store: str) -> list[str]:
    """The names of the runs stored, in order."""
    fs, where = _fs(spark, store)
    if not fs.exists(where):
        return []
    names = [m[1] for f in fs.listStatus(where) if f.isDirectory() and (m := _RUN.search(str(f.getPath().getName())))]
    return sorted(n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/run={n}/_SUCCESS")))


def settings(dialect: str, options: Options) -> str:
    """What cells depend on, as text."""
    o = options.checked()
    classes = hashlib.sha256(json.dumps(asdict(o.classes), sort_keys=True).encode()).hexdigest()
    return json.dumps({"dialect": dialect, "classes": classes, "zone": o.zone, "xff_capture": o.xff_capture}, sort_keys=True)


def put(lines: DataFrame, store: str, run: str, dialect: str, options: Options | None = None) -> bool:
    """Store the cells of events or parsed lines (with ``ord``) as a run; False, and nothing is read, if it is there."""
    spark, o = lines.sparkSession, (options or Options()).checked()
    if not _NAME.fullmatch(run):
        raise StoreError(f"{run!r} names no run: letters, digits, dots, dashes and underscores are wanted")
    if run in runs(spark, store):
        return False
    note = spark.createDataFrame([(settings(dialect, o),)], "label string").withColumn("kind", F.lit("run"))
    cells = cells_of(lines, o)
    cells = cells.withColumn("first_ord", F.col("first_ord").cast("decimal(38,0)")).withColumn("last_ord", F.col("last_ord").cast("decimal(38,0)"))
    cells.unionByName(note, allowMissingColumns=True).write.mode("overwrite").parquet(f"{store.rstrip('/')}/run={run}")
    return True


def append(spark: SparkSession, paths: list[str], store: str, run: str, dialect: str = "auto", options: Options | None = None) -> bool:
    """Read logs and store their cells as a run (see ``put``)."""
    if run in runs(spark, store):
        return False
    o = (options or Options()).checked()
    name, parsed = parsed_lines(spark, paths, dialect, o)
    return put(parsed, store, run, name, o)


def cells(spark: SparkSession, store: str, only: list[str] | None = None) -> tuple[str, DataFrame]:
    """The settings that the runs share, and their cells added up."""
    there = runs(spark, store)
    names = there if only is None else sorted(set(only))
    if missing := [n for n in names if n not in there]:
        raise StoreError(f"no run {', '.join(missing)} in {store}")
    if not names:
        raise StoreError(f"{store} holds no run")
    if len(names) > MOST_RUNS:
        raise StoreError(f"more than {MOST_RUNS} runs: add them up in parts")
    # Names are texts, whatever they look like, so the partition column isn't left to be guessed.
    first = spark.read.parquet(f"{store}/run={names[0]}").schema
    schema = T.StructType([*first.fields, T.StructField("run", T.StringType())])
    found = spark.read.schema(schema).option("basePath", store).parquet(*[f"{store}/run={n}" for n in names])
    told = [r[0] for r in found.where("kind = 'run'").select("label").distinct().limit(2).collect()]
    if len(told) != 1:
        raise StoreError("the runs were made by different dialects, classes or zones")
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), "__n long, run string"))  # a row a run
    before = F.col("__n").cast("decimal(18,0)") * F.lit(Decimal(1 << 108))
    rows = found.where("kind <> 'run'").join(numbers, "run")
    shifted = [(F.col(c) + before).cast("decimal(38,0)").alias(c) if c in ("first_ord", "last_ord") else F.col(c) for c in first.names]
    return told[0], M.merged(rows.select(*shifted))


def report(spark: SparkSession, store: str, options: Options | None = None, only: list[str] | None = None) -> dict:
    """The report of runs; ``options`` have to be those the runs were stored with, as far as cells depend on them."""
    o = (options or Options()).checked()
    if o.since or o.until:
        raise StoreError("set a window when a run is stored: counts can't be cut afterwards")
    told, found = cells(spark, store, only)
    dialect = json.loads(told)["dialect"]
    if told != settings(dialect, o):
        raise StoreError("the runs were stored with other classes, zone or capture than these")
    names = runs(spark, store) if only is None else sorted(set(only))
    return of_cells(found, dialect, f"{names[0]} to {names[-1]}" if len(names) > 1 else names[0], None, o)
