"""Versioned tables: a log of snapshots, each of which is there whole or not at all.

A table is a folder. Data goes to a fresh folder for each part and attempt; a
version is one small file below ``_versions``, which Spark's readers skip, that
names the folders it is made of. That file is created once, with its whole content, so whoever reads a version
reads the data that was complete before it. A job that dies between data and
version leaves a folder nobody reads; a retried commit finds its token in the
version that is there and adds nothing; of two writers of one version the
second fails, or tries the next one if the first changed other parts.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from steppe.storage import delete, names, put_if_absent, read_text


class VersionConflict(RuntimeError):
    """Another writer made this version, or changed the same parts."""


class Part(NamedTuple):
    """Rows of one key of a table, in a folder of their own."""

    folder: str
    rows: int
    note: str


class Snapshot(NamedTuple):
    version: int
    token: str
    parts: dict[str, Part]


def _file(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/_versions/{version:012d}.json"


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """A version of a table, the latest if none is given; None where the table has no version."""
    known = [int(n[:-5]) for n in names(spark, f"{path.rstrip('/')}/_versions") if n.endswith(".json") and n[:-5].isdigit()]
    if not known and version is None:
        return None
    if version is not None and version not in known:
        raise ValueError(f"{path} has no version {version}")
    found = json.loads(read_text(spark, _file(path, max(known) if version is None else version)))
    return Snapshot(found["version"], found["token"], {k: Part(*p) for k, p in found["parts"].items()})


def read(spark: SparkSession, path: str, schema: str, version: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """The rows of a version, or of some of its parts."""
    found = snapshot(spark, path, version)
    parts = found.parts if found else {}
    folders = [f"{path.rstrip('/')}/{p.folder}" for k, p in parts.items() if keys is None or k in keys]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def commit(
    spark: SparkSession, path: str, parts: dict[str, DataFrame], notes: dict[str, str] | None = None, version: int | None = None, token: str | None = None
) -> Snapshot:
    """Adds a version with some parts new or replaced; the others stay.

    ``version``: only this one may be made, and it must follow the latest.
    Without it the commit moves on behind other writers, as long as they changed
    other parts. ``token`` names the commit: with the token of a version that is
    there, nothing is written.
    """
    path, token, notes = path.rstrip("/"), token or uuid.uuid4().hex, notes or {}
    base = snapshot(spark, path)
    if base and base.token == token:
        return base
    if version is not None and version != (base.version + 1 if base else 0):
        raise VersionConflict(f"{path}: version {version} can't follow {base.version if base else 'nothing'}")
    fresh: dict[str, Part] = {}
    try:
        for key, df in parts.items():
            folder = f"part={key}/attempt={uuid.uuid4().hex}"
            fresh[key] = Part(folder, 0, notes.get(key, ""))
            df.write.parquet(f"{path}/{folder}")
            fresh[key] = fresh[key]._replace(rows=spark.read.parquet(f"{path}/{folder}").count())
    except Exception:
        _drop(spark, path, fresh, {})
        raise
    while True:
        now = Snapshot(base.version + 1 if base else 0, token, (base.parts if base else {}) | fresh)
        if put_if_absent(spark, _file(path, now.version), json.dumps(now._asdict(), sort_keys=True)):
            return now
        other = snapshot(spark, path, now.version)
        if other.token == token:  # this very commit, by a retry or by a first try whose answer was lost
            _drop(spark, path, fresh, other.parts)
            return other
        before = base.parts if base else {}
        if version is not None or any(other.parts.get(k) != before.get(k) for k in fresh):
            _drop(spark, path, fresh, other.parts)
            raise VersionConflict(f"{path}: another writer made version {now.version}")
        base = other


def _drop(spark: SparkSession, path: str, fresh: dict[str, Part], named: dict[str, Part]) -> None:
    """Deletes the data of a commit that came to nothing."""
    for key, part in fresh.items():
        if key not in named or named[key].folder != part.folder:
            delete(spark, f"{path}/{part.folder}")


def stale(spark: SparkSession, path: str) -> list[str]:
    """Data folders that no version names: what crashed jobs left, or running ones still write."""
    path = path.rstrip("/")
    used = set()
    for n in names(spark, f"{path}/_versions"):
        if n.endswith(".json") and n[:-5].isdigit():
            used |= {p.folder for p in snapshot(spark, path, int(n[:-5])).parts.values()}
    parts = [n for n in names(spark, path) if n.startswith("part=")]
    return [f"{p}/{n}" for p in parts for n in names(spark, f"{path}/{p}") if f"{p}/{n}" not in used]
