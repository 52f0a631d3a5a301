"""Reports of stored runs against the report of all lines."""

import random

import pytest

from tidegauge.operators.classes import ClassSet, Rule
from tidegauge.plans import store as S
from tidegauge.plans.report import Options, analyze


def line(day, second, path, status, wait):
    return f'203.0.113.{second % 5}:51 [{day:02d}/Mar/2026:10:00:{second:02d}.{second:03d}] web app/s1 0/0/1/{wait}/{wait} {status} 64 - - ---- 1/1/0/0/0 0/0 {{h{second % 3}.test}} "GET {path} HTTP/1.1"'


@pytest.fixture(scope="module")
def days(tmp_path_factory):
    folder, rnd = tmp_path_factory.mktemp("days"), random.Random(3)
    for d in range(1, 4):
        rows = [line(d, s, f"/p{int(rnd.random() ** 2 * 30)}" + rnd.choice(["", ".js"]), rnd.choice([200] * 8 + [404, 503]), rnd.choice([1, 30, 1500, 8000, -1])) for s in sorted(rnd.choices(range(60), k=120))]
        (folder / f"d{d}.log").write_text("\n".join([*rows, "daemon started", rows[0].split("] ")[0] + "] web app/s1"]) + "\n")
    return folder


def test_three_days_add_up(spark, days, tmp_path, monkeypatch):
    """Also with a cap on paths, which depends on what was seen first."""
    store, paths = str(tmp_path / "cells"), [str(days / f"d{d}.log") for d in (1, 2, 3)]
    assert S.runs(spark, store) == []
    for d in (3, 1, 2):  # in any order: runs count by name
        assert S.append(spark, [paths[d - 1]], store, f"2026-03-0{d}", "haproxy")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cells").rglob("*")}
    assert not S.append(spark, ["/no/such.log"], store, "2026-03-02", "haproxy")
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "cells").rglob("*")} == before
    for o in (Options(pool_size=5, pool_min_ok=0.5), Options(max_paths=7)):
        whole = analyze(spark, paths, "haproxy", o).report
        monkeypatch.setattr("tidegauge.sources.reader.open_file", None)  # no line is read again
        added = S.report(spark, store, o)
        monkeypatch.undo()
        assert added["source"] == "2026-03-01 to 2026-03-03"
        assert {k: v for k, v in added.items() if k != "source"} == {k: v for k, v in whole.items() if k != "source"}
    two = S.report(spark, store, only=["2026-03-03", "2026-03-02"])
    whole = analyze(spark, paths[1:], "haproxy").report
    assert {k: v for k, v in two.items() if k != "source"} == {k: v for k, v in whole.items() if k != "source"}
    assert S.report(spark, store, only=["2026-03-01"])["counts"]["malformed"] == 1


def test_what_cannot_be_added_up(spark, days, tmp_path):
    store, one = str(tmp_path / "cells"), str(days / "d1.log")
    with pytest.raises(S.StoreError, match="holds no run"):
        S.report(spark, store)
    with pytest.raises(S.StoreError, match="names no run"):
        S.append(spark, [one], store, "../x", "haproxy")
    assert S.append(spark, [one], store, "007", "haproxy") and S.runs(spark, store) == ["007"]
    with pytest.raises(S.StoreError, match="no run 008"):
        S.report(spark, store, only=["007", "008"])
    own = Options(classes=ClassSet((Rule("js", path_suffixes=(".js",)),), "rest"))
    with pytest.raises(S.StoreError, match="other classes"):
        S.report(spark, store, own)
    (tmp_path / "cells/run=007/_SUCCESS").rename(tmp_path / "cells/run=007/_gone")  # as if the job had broken off
    assert S.runs(spark, store) == [] and S.append(spark, [one], store, "007", "haproxy")
    assert S.append(spark, [one], store, "008", "haproxy", own)
    with pytest.raises(S.StoreError, match="different"):
        S.report(spark, store)


def test_the_command_line_keeps_a_store(spark, days, tmp_path):
    import io
    import json

    from tidegauge.cli import main

    store, out = str(tmp_path / "cells"), f"file://{tmp_path}/r.json"
    for d in (1, 2, 2):
        err = io.StringIO()
        assert main(["analyze", "--dialect", "haproxy", "--format", "json", "--store", store, "--run", f"d{d}", str(days / f"d{d}.log"), "-o", out], spark, io.StringIO(), err) == 0
    assert "d2 is stored already" in err.getvalue()
    got = json.loads((tmp_path / "r.json").read_text())
    assert got["source"] == "d1 to d2" and got["counts"]["lines"] == 244
    again = io.StringIO()
    assert main(["analyze", "--format", "json", "--store", store], spark, again, io.StringIO()) == 0 and json.loads(again.getvalue()) == got
    for bad in (["analyze", "--store", store, "--run", "x"], ["analyze", "--store", store, str(days / "d1.log")], ["analyze", "--store", str(tmp_path / "none")]):
        assert main(bad, spark, io.StringIO(), io.StringIO()) == 2
