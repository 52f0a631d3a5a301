"""The line data source: ranges, gzip members, the cap, memory, and the way for stores that Python doesn't open."""

import gzip
import io
import os
import random
import subprocess
import sys

import pyarrow as pa
import pytest

from tidegauge.sources import read_lines
from tidegauge.sources import reader as R


def lines(files, split, cap=R.LINE_CAP):
    rows = [r for part in R.planned(files, split) for b in R._rows(part, cap, pa.int32(), "file_idx") for r in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3).cast(pa.binary()).to_pylist())]
    return [r[3] for r in sorted(rows, key=lambda r: r[:3])]


def cut(text):
    want = text.split(b"\n")
    return want[:-1] if want[-1] == b"" else want


@pytest.mark.parametrize("kind", ["plain", "gzip", "members", "padded"])
def test_any_split_gives_each_line_once(kind, tmp_path):
    rnd = random.Random(kind)
    for t in range(40):
        text = b"".join(bytes(rnd.choices(b"ab\xff \r", k=rnd.choice([0, 1, 3, 20, 200]))) + b"\n" for _ in range(rnd.randint(0, 50)))
        text = text[:-1] if t % 3 == 0 else text
        step = rnd.choice([1, 7, 50, 400])
        raw = text if kind == "plain" else gzip.compress(text) if kind == "gzip" else b"".join(gzip.compress(text[i : i + step]) for i in range(0, len(text) or 1, step))
        path = tmp_path / f"f{t}"
        path.write_bytes(raw + b"\0" * (5000 if kind == "padded" else 0))
        for split in (0, 1, 13, 100, 1000, 1 << 20):
            if split > 1 or len(raw) < 400:
                assert lines([str(path)], split) == cut(text), (t, split)


def test_a_member_stored_inside_another_stops_the_run(tmp_path):
    """Stored, not packed: the inner file's bytes lie in the outer one as they are."""
    inner = gzip.compress(b"inner line\n" * 50)
    outer = io.BytesIO()
    with gzip.GzipFile(fileobj=outer, mode="wb", compresslevel=0) as f:
        f.write(b"before\n" + inner + b"\nafter\n")
    path = tmp_path / "odd.gz"
    path.write_bytes(outer.getvalue() + gzip.compress(b"last\n"))
    assert lines([str(path)], 0) == [b"before", *cut(inner + b"\nafter\n"), b"last"]
    with pytest.raises(ValueError, match="split 0"):
        lines([str(path)], 20)


def test_cut_off_gzip_and_long_lines_fail(spark, tmp_path):
    path = tmp_path / "cut.log"
    path.write_bytes(gzip.compress(os.urandom(5000).hex().encode())[:-20])
    with pytest.raises(EOFError):
        lines([str(path)], 0)
    for schemes in (("file",), ()):
        with pytest.raises(Exception, match="within a gzip member"):
            read_lines(spark, [str(path)], schemes=schemes).count()
    huge = tmp_path / "huge.log"
    with open(huge, "wb") as f:
        f.write(b"short\n")
        f.truncate(5 << 30)  # one line of 5 GiB, without a break
    with pytest.raises(R.LineTooLong):
        lines([str(huge)], 1 << 30)
    with pytest.raises(Exception, match="cap of 1 MiB"):
        read_lines(spark, [str(huge)]).count()
    packed = tmp_path / "packed.log"
    packed.write_bytes(gzip.compress(b"x" * (3 << 20)))
    for schemes in (("file",), ()):
        with pytest.raises(Exception, match="reaches the cap"):
            read_lines(spark, [str(packed)], schemes=schemes).count()
    edge = tmp_path / "edge.log"
    edge.write_bytes(b"y" * (R.LINE_CAP - 1) + b"\nz\n")
    assert [len(r.value) for r in read_lines(spark, [str(edge)], split=1000).orderBy("line_block", "line_no").collect()] == [R.LINE_CAP - 1, 1]


def test_other_stores_inflate_as_a_stream(spark, tmp_path):
    """Bytes that end in a line break, several members, zeros behind, invalid UTF-8, a plain file by a packed name."""
    text = b"".join(b"%d \xff\r\n" % i for i in range(3000))
    files = {"one.log": gzip.compress(text), "two.log": gzip.compress(text[:999]) + gzip.compress(text[999:]) + b"\0" * 77, "plain.gz": text, "right.gz": gzip.compress(text), "empty.log": b""}
    size = 10 << 24  # its highest byte, the file's last one, is a line break
    lined = b"".join(b"%07d\n" % i for i in range(size // 8))
    files["break.log"] = gzip.compress(lined, 1)
    assert files["break.log"].endswith(b"\n")
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    paths = [str(tmp_path / n) for n in files]
    want = sorted((i, j, v.decode("utf-8", "replace").removesuffix("\r")) for i, n in enumerate(files) for j, v in enumerate(cut(text) if n not in ("empty.log", "break.log") else []))
    assert read_lines(spark, [paths[-1]], schemes=()).count() == read_lines(spark, [paths[-1]]).count() == size // 8
    for kw in ({"schemes": ()}, {}, {"split": 100}):
        got = read_lines(spark, paths[:-1], **kw).orderBy("file_idx", "line_block", "line_no").collect()
        seen, rows = {}, []
        for r in got:
            rows.append((r.file_idx, seen.get(r.file_idx, 0), r.value))
            seen[r.file_idx] = seen.get(r.file_idx, 0) + 1
        assert rows == want, kw


def test_a_large_gzip_by_another_name_stays_small_in_memory(tmp_path):
    """About 400 MB of text in one member, read by a process that may grow by less than 150 MB."""
    path = tmp_path / "rotated.1"
    with gzip.open(path, "wb", compresslevel=1) as f:
        for i in range(40):
            f.write(b"".join(b"%08d some line of a log that says little\n" % (i * 200_000 + j) for j in range(200_000)))
    code = f"""
import resource, sys
sys.path.insert(0, {str(os.getcwd())!r})
from tidegauge.sources import reader as R
import pyarrow as pa
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for part in R.planned([{str(path)!r}], R.SPLIT) for b in R._rows(part, R.LINE_CAP, pa.int32(), "file_idx"))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    n, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n == 8_000_000 and grown < 150_000
