"""Versioned commits: crashes, retries, two writers; files that appear whole."""

from __future__ import annotations

import json
import os
import threading

import pytest

from steppe import storage
from steppe.functions import geo
from steppe.sources import readers as R
from steppe.sources import versions as V

SCHEMA = "k long, x string"


def frame(spark, n, x="a"):
    return spark.range(n).selectExpr("id AS k", f"'{x}' AS x")


def rows(spark, path, **which):
    return sorted((r["k"], r["x"]) for r in V.read(spark, path, SCHEMA, **which).collect())


def test_versions_are_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert V.snapshot(spark, path) is None and rows(spark, path) == []
    assert V.commit(spark, path, {"a": frame(spark, 2), "b": frame(spark, 1, "b")}).version == 0
    second = V.commit(spark, path, {"b": frame(spark, 3, "c")}, {"b": "note"})
    assert second.version == 1 and second.parts["b"].rows == 3 and second.parts["b"].note == "note"
    assert rows(spark, path) == [(0, "a"), (0, "c"), (1, "a"), (1, "c"), (2, "c")]
    assert rows(spark, path, version=0) == [(0, "a"), (0, "b"), (1, "a")]
    assert rows(spark, path, keys=["b"]) == [(0, "c"), (1, "c"), (2, "c")]
    with pytest.raises(ValueError):
        V.snapshot(spark, path, 7)


def test_a_crash_between_data_and_version_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.commit(spark, path, {"a": frame(spark, 2)})

    class Killed(BaseException):
        pass

    def killed(*_):
        raise Killed

    with monkeypatch.context() as m:  # as if the process had ended: nothing is tidied up either
        m.setattr(V, "put_if_absent", killed)
        m.setattr(V, "delete", lambda *_: None)
        with pytest.raises(Killed):
            V.commit(spark, path, {"a": frame(spark, 5)})
    assert rows(spark, path) == [(0, "a"), (1, "a")] and len(V.stale(spark, path)) == 1
    with pytest.raises(Exception, match="no rows"):
        V.commit(spark, path, {"a": frame(spark, 5).selectExpr("k", "CAST(raise_error('no rows') AS STRING) AS x")})
    assert rows(spark, path) == [(0, "a"), (1, "a")]


def test_a_retried_commit_adds_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.commit(spark, path, {"a": frame(spark, 2)}, token="one")
    assert V.commit(spark, path, {"a": frame(spark, 2)}, token="one").version == 0
    put = V.put_if_absent

    def lost_answer(*args):  # the file was made, but the writer did not hear of it
        put(*args)
        return False

    monkeypatch.setattr(V, "put_if_absent", lost_answer)
    done = V.commit(spark, path, {"a": frame(spark, 3)}, token="two")
    monkeypatch.undo()
    assert done.version == 1 and V.snapshot(spark, path).version == 1 and len(rows(spark, path)) == 3


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    V.commit(spark, path, {"a": frame(spark, 1)})
    with pytest.raises(V.VersionConflict):
        V.commit(spark, path, {"a": frame(spark, 1)}, version=0)
    failed, meet = [], threading.Barrier(4)

    def write(n):
        meet.wait()
        try:
            V.commit(spark, path, {f"w{n}": frame(spark, n + 1, f"w{n}")})
        except V.VersionConflict as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and V.snapshot(spark, path).version == 4  # four keys, four versions, no row lost or doubled
    assert len(rows(spark, path)) == 1 + 1 + 2 + 3 + 4


def test_writers_of_the_same_part_conflict(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.commit(spark, path, {"a": frame(spark, 1)})
    put, once = V.put_if_absent, []

    def other_first(session, where, text):
        if not once:
            once.append(1)
            monkeypatch.setattr(V, "put_if_absent", put)
            V.commit(session, path, {"a": frame(session, 2, "other")})
        return put(session, where, text)

    monkeypatch.setattr(V, "put_if_absent", other_first)
    with pytest.raises(V.VersionConflict):
        V.commit(spark, path, {"a": frame(spark, 3, "mine")})
    assert rows(spark, path) == [(0, "other"), (1, "other")] and V.stale(spark, path) == []


def test_years_become_visible_with_their_note(spark, tmp_path):
    path = str(tmp_path / "years")
    read = lambda year: spark.createDataFrame([(1, year * 1.0), (2, 0.5)], "cell_id long, x double")
    assert R.load_years(spark, read, path, [2001, 2002], ["cell_id", "x"]) == [2001, 2002]
    assert R.load_years(spark, read, path, [2001, 2003], ["cell_id", "x"]) == [2003]
    wide = lambda year: read(year).selectExpr("cell_id", "x", "x AS y")
    assert R.load_years(spark, wide, path, [2001], ["cell_id", "x", "y"]) == [2001]  # other columns: replaced, not added
    now = R.read_years(spark, path, "cell_id long, x double, y double")
    assert now.count() == 6 and now.filter("year = 2001 AND y IS NOT NULL").count() == 2
    assert R.read_years(spark, path, "cell_id long, x double", [2002], 1).count() == 2


def test_files_appear_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.json")
    R.write_json(path, {"a": 1})
    monkeypatch.setattr(os, "fsync", lambda _: (_ for _ in ()).throw(OSError("disk is full")))
    with pytest.raises(OSError):
        R.write_json(path, {"a": 2})
    monkeypatch.undo()
    assert json.load(open(path)) == {"a": 1} and os.listdir(tmp_path) == ["x.json"]
    cells = spark.createDataFrame([(1, 30.0, 37.0)], "cell_id long, lon double, lat double")
    bad = cells.selectExpr("cell_id", "lon", "CAST(raise_error('gone') AS DOUBLE) AS lat")
    with pytest.raises(Exception, match="gone"):
        geo.write_geojson(bad, path, 0.1, ["cell_id"])
    assert json.load(open(path)) == {"a": 1} and os.listdir(tmp_path) == ["x.json"]


def test_put_if_absent_and_the_shared_folder(spark, tmp_path):
    assert storage.put_if_absent(spark, f"{tmp_path}/d/x", "one") and not storage.put_if_absent(spark, f"{tmp_path}/d/x", "two")
    assert storage.read_text(spark, f"file://{tmp_path}/d/x") == "one" and "x" in storage.names(spark, f"{tmp_path}/d")

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *_: None)}), Context

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session)
