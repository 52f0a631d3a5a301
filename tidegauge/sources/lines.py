"""Lines of log files, in order.

Files that Python can open where tasks run (by default those of a file system mounted everywhere) are read by the data
source of ``reader``: gzip told by its first two bytes and inflated as a stream, the line cap checked while reading.
Other stores go through Spark's splittable text reader, their gzip files too, whatever their name: a gzip file's bytes
are read as if they were text, brought together in order and inflated as a stream. Each line carries its file's place in
the argument list and an order within the file, so later steps can speak of "first" and "last".
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import uuid
import zlib
from collections.abc import Collection, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.reader import LINE_CAP, NAME, SCHEMA, SPLIT, LineSource, lines_of, size_of, whole_lines

_GZIP = b"\x1f\x8b"
#: Slashes after a URL's scheme, which are written as one or as three, and what stands for them in a comparison.
_URL = (r"^([A-Za-z0-9+.-]+:)/+", "$1/")
#: Names that Spark's text reader unpacks; of these the data source knows gzip alone.
_GZIP_NAMES = (".gz", ".gzip")
_CODECS = (*_GZIP_NAMES, ".bz2", ".deflate", ".zst", ".snappy", ".lz4")
#: Stores whose files Python opens in tasks.
OPENED = ("file",)


def first_bytes(spark: SparkSession, path: str, n: int = 2) -> bytes:
    """The first bytes of a file in any store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def head_lines(spark: SparkSession, path: str, n: int = LINE_CAP) -> list[str]:
    """The lines within the first ``n`` bytes of a file's text, gzip unpacked; one that may be cut by the bound isn't given."""
    text = raw = first_bytes(spark, path, n)
    if raw[:2] == _GZIP:
        text = b""
        while raw[:2] == _GZIP and len(text) < n:
            member = zlib.decompressobj(31)
            text += member.decompress(raw, n - len(text))
            raw = member.unused_data
    lines = text.decode("utf-8", "replace").split("\n")
    if lines[-1] == "" or len(text) >= n:
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share; a local one of our own only in one JVM."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidegauge/{name}-{uuid.uuid4().hex}"


def spool_stdin(spark: SparkSession) -> str:
    """Standard input copied, piece by piece, to a file under the folder that driver and executors share."""
    where = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, "stdin") + ".log")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        while piece := sys.stdin.buffer.read(1 << 22):
            out.write(piece)
    finally:
        out.close()
    return str(where.toString())


def resolve(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that arguments name, in order: ``-`` is spooled, a directory or a pattern gives its files by name.

    Names that begin with a dot or an underscore are left out of directories and patterns.
    """
    out: list[str] = []
    for p in paths:
        if p == "-":
            out.append(spool_stdin(spark))
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(where) and fs.getFileStatus(where).isFile():
            out.append(p)
            continue
        found = fs.listStatus(where) if fs.exists(where) else fs.globStatus(where) or []
        names = sorted(str(f.getPath().toString()) for f in found if f.isFile())
        names = [x for x in names if not x.rsplit("/", 1)[-1].startswith((".", "_"))]
        if not names:
            raise FileNotFoundError(f"{p} names no log")
        out += names
    return out


def _inflated(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Lines of gzip files from their bytes as "lines" (path, piece), which come in order; a task holds a piece at a time."""
    pieces = ((p, v) for b in batches for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    now = next(pieces, None)
    while now is not None:
        path = now[0]

        def raw() -> Iterator[bytes]:
            nonlocal now
            while now is not None and now[0] == path:
                yield now[1] + b"\n"
                now = next(pieces, None)

        no = 0
        for block in whole_lines(_members(raw(), path), iter(()), True, cap, path):
            values = lines_of(block, cap, path)
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(no, no + n), pa.int64()), values], names=["path", "line_no", "value"])
            no += n


def _members(raw: Iterator[bytes], name: str, piece: int = 1 << 20) -> Iterator[bytes]:
    """The text of all members of a gzip stream."""
    inflater = None
    for data in raw:
        while data:
            if inflater is None:
                data = data.lstrip(b"\0")
                if not data or data == b"\n":  # the break added to the last piece
                    break
                inflater = zlib.decompressobj(31)
            text = inflater.decompress(data, piece)
            if text:
                yield text
            data = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
            if inflater.eof:
                inflater = None
    if inflater is not None:
        raise EOFError(f"{name} ends within a gzip member")


def _whole(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Lines of plain files whose names say that they are packed: whole files, 2 GB at most (Spark's bound)."""
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            no = 0
            for block in whole_lines((raw[i : i + (1 << 20)] for i in range(0, len(raw), 1 << 20)), iter(()), True, cap, path):
                values = lines_of(block, cap, path)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(values)), pa.array(range(no, no + len(values)), pa.int64()), values], names=["path", "line_no", "value"])
                no += len(values)


def _url(spark: SparkSession, path: str) -> str:
    """A path as Spark's file metadata writes it, but for the slashes after the scheme (see ``_URL``)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where)
    return re.sub(_URL[0], _URL[1].replace("$", "\\"), str(full.toUri().toString()))


def opened_here(spark: SparkSession, path: str, schemes: Collection[str] = OPENED) -> bool:
    """Whether tasks can open a file by Python, and it is plain or gzip as far as its name tells."""
    given = re.match("([A-Za-z][A-Za-z0-9+.-]*):/", path)
    scheme = (given or re.match("([A-Za-z][A-Za-z0-9+.-]*):/", str(spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///"))))[1]
    return scheme in schemes and (not path.lower().endswith(_CODECS) or path.lower().endswith(_GZIP_NAMES))


def _by_source(spark: SparkSession, files: list[str], split: int, cap: int) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.read.format(NAME).option("files", json.dumps(files)).option("split", split).option("cap", cap).load()


def _by_spark(spark: SparkSession, files: list[tuple[int, str]], cap: int) -> DataFrame:
    """One scan for files that Spark unpacks by their names, one for gzip files by other names."""
    urls = {p: _url(spark, p) for _, p in files}
    distinct = list({u: p for p, u in urls.items()}.values())  # a file may be named in several ways
    with ThreadPoolExecutor(16) as pool:
        squeezed = dict(zip(distinct, pool.map(lambda p: first_bytes(spark, p) == _GZIP, distinct)))
    named = lambda p: p.lower().endswith(_CODECS)
    gz_named = lambda p: p.lower().endswith(_GZIP_NAMES)
    told = [p for p in distinct if (squeezed[p] if gz_named(p) else named(p) or not squeezed[p])]
    hidden, false = [p for p in distinct if squeezed[p] and not named(p)], [p for p in distinct if gz_named(p) and not squeezed[p]]
    path, block = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("line_block")
    scans, text = [], spark.read.option("lineSep", "\n")
    if told:
        scans.append(text.text(told).select(path, block, F.monotonically_increasing_id().alias("line_no"), "value"))
    if hidden:
        pieces = text.text(hidden).select(path, block, F.monotonically_increasing_id().alias("line_no"), F.col("value").cast("binary").alias("value"))
        ordered = pieces.repartition("path").sortWithinPartitions("path", "line_block", "line_no").select("path", "value")
        scans.append(ordered.mapInArrow(partial(_inflated, cap=cap), "path string, line_no long, value string").select("path", F.lit(0).cast("long").alias("line_block"), "line_no", "value"))
    if false:
        whole = spark.read.format("binaryFile").load(false).select(path, "content").mapInArrow(partial(_whole, cap=cap), "path string, line_no long, value string")
        scans.append(whole.select("path", F.lit(0).cast("long").alias("line_block"), "line_no", "value"))
    raw = scans[0]
    for one in scans[1:]:
        raw = raw.unionByName(one)
    # A row a named file, so the broadcast has the size of the argument list.
    places = spark.createDataFrame([(urls[p], i) for i, p in files], "__url string, file_idx int")
    out = raw.join(F.broadcast(places), F.regexp_replace("path", *_URL) == F.col("__url")).select("file_idx", "line_block", "line_no", "value")
    too_long = F.octet_length("value") >= cap  # this reader has the whole line by then
    return out.withColumn("value", F.when(too_long, F.raise_error(F.lit(f"a line reaches the cap of {cap} bytes"))).otherwise(F.col("value")))


def read_files(spark: SparkSession, files: list[str], cap: int = LINE_CAP, split: int = SPLIT, schemes: Collection[str] = OPENED) -> DataFrame:
    """``read_lines`` of files already resolved; ``split``: bytes of a range, ``schemes``: stores whose files Python opens in tasks."""
    if not files:
        raise ValueError("no log to read")
    own = [opened_here(spark, p, schemes) for p in files]
    others = [(i, p) for i, (p, here) in enumerate(zip(files, own)) if not here]
    out = None
    if any(own):
        mine = [i for i, here in enumerate(own) if here]
        out = _by_source(spark, [files[i] for i in mine], split, cap)
        if others:
            out = out.withColumn("file_idx", F.get(F.lit(mine).cast("array<int>"), "file_idx"))
    if others:
        rest = _by_spark(spark, others, cap)
        out = rest if out is None else out.unionByName(rest)
    return out.withColumn("value", F.regexp_replace("value", "\r$", ""))


def one_range(spark: SparkSession, files: list[str], split: int = SPLIT) -> bool:
    """Whether each file is read as one range, as far as can be told without reading."""
    return all(opened_here(spark, p) and size_of(p) <= split for p in files)


def read_lines(spark: SparkSession, paths: list[str], **kw) -> DataFrame:
    """file_idx, line_block, line_no, value of all files, in the order given; a path named twice counts twice.

    A path may be a directory or a pattern, too.
    """
    return read_files(spark, resolve(spark, paths), **kw)


def source_label(paths: list[str]) -> str:
    if not paths:
        return "(none)"
    if len(paths) == 1:
        return "(standard input)" if paths[0] == "-" else paths[0]
    return f"{os.path.basename(paths[0])} and {len(paths) - 1} more"
