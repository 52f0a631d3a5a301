"""A Spark data source of log lines: files cut into ranges, gzip inflated as a stream, a line's size checked as it is read.

What a file is is told by its first two bytes, in the task that reads it. Plain files are cut at any byte. A gzip file of
several members (joined files, or blocks of some tools) is cut at member starts: a range reads the members that start in
it. As with any cut text, a range that isn't its file's first leaves its text up to the first line break to the range
before it, which reads on until that break. No task holds more than a piece of about a MiB and one line.

A member start inside a range is found by its header and by inflating from there. Text that looks like one by chance is
told apart by the range before, which comes upon the true next start by reading: where both differ, the run fails with a
message, and ``split`` 0 (one range a file) reads such a file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "access_log_lines"
#: Bytes a line may have; a longer one fails the run.
LINE_CAP = 1 << 20
#: Bytes of a range, what opening a file counts in bytes when small ones are put together, and bytes read at a time.
SPLIT, OPEN_COST, PIECE = 128 << 20, 4 << 20, 1 << 20
SCHEMA = "file_idx int, line_block long, line_no long, value string"
TAIL_SCHEMA = "file string, line_block long, line_no long, value string"
_GZIP, _MEMBER = b"\x1f\x8b", b"\x1f\x8b\x08"
#: Text inflated from a member's header before it counts as one.
_PROOF = 1 << 20


class LineTooLong(ValueError):
    """A line reaches the cap."""


def local_path(uri: str) -> str | None:
    """The path of a file in the local file system, None of any other. Addresses are as Hadoop writes them, without escapes."""
    if uri.startswith("file:/"):
        return "/" + uri[5:].lstrip("/")
    return None if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", uri) else uri


def open_file(uri: str) -> BinaryIO:
    """A file for reading: local ones by Python, others by Arrow."""
    if (path := local_path(uri)) is not None:
        return open(path, "rb")
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return fs.open_input_file(path)


def size_of(uri: str) -> int:
    if (path := local_path(uri)) is not None:
        return os.path.getsize(path)
    with open_file(uri) as f:
        return f.size()


class Members:
    """The text of the gzip members of a file from one that starts at ``at``; ``start`` moves on as members end."""

    def __init__(self, f: BinaryIO, at: int, name: str):
        self.f, self.start, self.name = f, at, name

    def texts(self, until: int | None = None) -> Iterator[bytes]:
        """Text of members that start before ``until``, from ``start`` on; then ``start`` is the next member's, or None at the end."""
        while self.start is not None and (until is None or self.start < until):
            self.f.seek(self.start)
            at, inflater = self.start, zlib.decompressobj(31)
            raw = b""
            while not inflater.eof:
                raw = inflater.unconsumed_tail or self.f.read(PIECE)
                if not raw:
                    raise EOFError(f"{self.name} ends within a gzip member")
                at += 0 if inflater.unconsumed_tail else len(raw)
                if text := inflater.decompress(raw, PIECE):
                    yield text
            self.start = self._next(at - len(inflater.unused_data))

    def _next(self, at: int) -> int | None:
        """The start behind zero bytes, which may fill a file up."""
        self.f.seek(at)
        while raw := self.f.read(4096):
            if left := raw.lstrip(b"\0"):
                return at + len(raw) - len(left)
            at += len(raw)
        return None


def is_member(f: BinaryIO, at: int) -> bool:
    """Inflates from a place: a whole member, or at least ``_PROOF`` bytes of one."""
    f.seek(at)
    inflater, made = zlib.decompressobj(31), 0
    try:
        while not inflater.eof and made < _PROOF:
            raw = inflater.unconsumed_tail or f.read(1 << 16)
            if not raw:
                return False
            made += len(inflater.decompress(raw, _PROOF))
    except zlib.error:
        return False
    return True


def first_member(f: BinaryIO, begin: int, end: int) -> int | None:
    """The first member start in a range of a gzip file."""
    if begin == 0:
        return 0
    at = begin
    while at < end:
        f.seek(at)
        raw = f.read(min(PIECE, end - at) + len(_MEMBER))
        hit = raw.find(_MEMBER)
        while hit >= 0 and at + hit < end:
            if is_member(f, at + hit):
                return at + hit
            hit = raw.find(_MEMBER, hit + 1)
        if len(raw) <= len(_MEMBER):
            break
        at += min(PIECE, end - at)
    return None


def _plain(f: BinaryIO, begin: int, end: int | None) -> Iterator[bytes]:
    f.seek(begin)
    while (left := PIECE if end is None else min(PIECE, end - begin)) > 0 and (raw := f.read(left)):
        begin += len(raw)
        yield raw


def _checked(line: bytes, cap: int, name: str) -> bytes:
    if len(line) >= cap:
        raise LineTooLong(f"a line reaches the cap of {cap >> 20} MiB in {name}" if cap >= 1 << 20 else f"a line reaches the cap of {cap} bytes in {name}")
    return line


def whole_lines(own: Iterator[bytes], after: Iterator[bytes], first: bool, cap: int, name: str) -> Iterator[bytes]:
    """Blocks of whole lines, without the last break, of a range's text ``own`` and of what follows it."""
    held = b""
    for text in own:
        if not first:
            at = text.find(b"\n")
            if at < 0:
                continue
            text, first = text[at + 1 :], True
        cut = text.rfind(b"\n")
        if cut < 0:
            held = _checked(held + text, cap, name)
            continue
        yield held + text[:cut]
        held = _checked(text[cut + 1 :], cap, name)
    if not first:
        return
    for text in after:
        at = text.find(b"\n")
        held = _checked(held + (text if at < 0 else text[:at]), cap, name)
        if at >= 0:
            yield held
            return
    if held:
        yield held


def range_lines(f: BinaryIO, name: str, begin: int, end: int, size: int, cap: int) -> Iterator[bytes]:
    """Blocks of whole lines of a range of a file."""
    f.seek(0)
    if f.read(2) != _GZIP:
        yield from whole_lines(_plain(f, begin, end), _plain(f, end, None), begin == 0, cap, name)
        return
    start = first_member(f, begin, end)
    if start is None:
        return
    members = Members(f, start, name)

    def after() -> Iterator[bytes]:
        known = members.start
        if known is not None and first_member(f, end, known + 1) != known:
            raise ValueError(f"{name} holds what looks like a gzip member inside another: read it with split 0")
        yield from members.texts()

    yield from whole_lines(members.texts(end), after(), begin == 0, cap, name)


def lines_of(block: bytes, cap: int, name: str) -> pa.Array:
    """The lines of a block, as they are (whatever their encoding)."""
    whole = pa.Array.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(block)], np.int64).tobytes()), pa.py_buffer(block)])
    lines = pc.split_pattern(whole, "\n").flatten()
    if len(block) >= cap and (longest := pc.max(pc.binary_length(lines)).as_py()) >= cap:
        _checked(b" " * longest, cap, name)
    return lines.cast(pa.binary()).view(pa.string())


@dataclass
class Ranges(InputPartition):
    """file_idx, address, begin, end and file size of what one task reads."""

    ranges: list[tuple[int, str, int, int, int]]


def planned(files: Sequence[str], split: int) -> list[list[tuple[int, str, int, int, int]]]:
    """Ranges of files in order, small ones put together up to ``split`` bytes. 0: one range a file."""
    out: list[list] = []
    room = 0
    for i, name in enumerate(files):
        size = size_of(name)
        for begin in range(0, size, split) if split else [0] if size else []:
            end = min(size, begin + split) if split else size
            if room < end - begin + OPEN_COST or not split:
                out.append([])
                room = split
            out[-1].append((i, name, begin, end, size))
            room -= end - begin + OPEN_COST
    return out


def _rows(ranges: list[tuple[int | str, str, int, int, int]], cap: int, key: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    for i, uri, begin, end, size in ranges:
        with open_file(uri) as f:
            no = 0
            for block in range_lines(f, uri, begin, end, size, cap):
                values = lines_of(block, cap, uri)
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, key), pa.array(np.full(n, begin)), pa.array(np.arange(no, no + n)), values], names=[name, "line_block", "line_no", "value"])
                no += n


class LineReader(DataSourceReader):
    def __init__(self, files: list[str], split: int, cap: int):
        self.files, self.split, self.cap = files, split, cap

    def partitions(self) -> list[Ranges]:
        return [Ranges(r) for r in planned(self.files, self.split)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _rows(partition.ranges, self.cap, pa.int32(), "file_idx")


class TailReader(DataSourceStreamReader):
    """Lines as they are added to the files of a folder: an offset is how far each file has been read, to a line break.

    Files are known by name; one that gets shorter is an error. A last line without a break waits for it. Gzip files are
    read once whole, when they appear; move them in complete.
    """

    def __init__(self, folder: str, pattern: str, cap: int):
        self.folder, self.pattern, self.cap = folder, pattern, cap

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from fnmatch import fnmatch

        found = {}
        for entry in sorted(os.scandir(self.folder), key=lambda e: e.name):
            if entry.is_file() and fnmatch(entry.name, self.pattern) and not entry.name.startswith((".", "_")):
                found[entry.path] = self._settled(entry.path, entry.stat().st_size)
        return {k: v for k, v in found.items() if v}

    def _settled(self, path: str, size: int) -> int:
        """The place behind the last line break."""
        with open(path, "rb") as f:
            if f.read(2) == _GZIP:
                return size
            at = size
            while at > 0:
                begin = max(0, at - (1 << 16))
                f.seek(begin)
                cut = f.read(at - begin).rfind(b"\n")
                if cut >= 0:
                    return begin + cut + 1
                at = begin
                if size - at > self.cap:
                    raise LineTooLong(f"a line reaches the cap of {self.cap >> 20} MiB in {path}")
        return 0

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out = []
        for path, to in end.items():
            at = start.get(path, 0)
            if to < at:
                raise ValueError(f"{path} has become shorter")
            if to > at:
                out.append(Ranges([(path, path, at, to, to)]))
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        (path, _, begin, end, _), no = partition.ranges[0], 0
        with open(path, "rb") as f:
            gz = f.read(2) == _GZIP
            blocks = range_lines(f, path, 0, end, end, self.cap) if gz else whole_lines(_plain(f, begin, end), iter(()), True, self.cap, path)
            for block in blocks:
                values = lines_of(block, self.cap, path)
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, begin)), pa.array(np.arange(no, no + n)), values], names=["file", "line_block", "line_no", "value"])
                no += n

    def commit(self, end: dict) -> None:
        pass


class LineSource(DataSource):
    """Batch: option ``files`` (JSON list), ``split``, ``cap``. Stream: ``folder``, ``pattern``, ``cap``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TAIL_SCHEMA if "folder" in self.options else SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(json.loads(self.options["files"]), int(self.options.get("split", SPLIT)), int(self.options.get("cap", LINE_CAP)))

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["folder"], self.options.get("pattern", "*"), int(self.options.get("cap", LINE_CAP)))
