"""Stored slot maps: no row is lost or doubled, and every place equals a plain recomputation."""

from __future__ import annotations

import collections
import os
import zlib

import pytest
from pyspark.sql import functions as F

from steppe.llm import sharding
from steppe.sources import versions

from .helpers import documents, with_clashes


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id % 400) AS text").cache()


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_placement_equals_a_plain_one(spark, tmp_path):
    """Slots from the hash, loads, the heaviest slot first to the lightest shard, places in order."""
    docs = with_clashes(documents(spark)).unionByName(with_clashes(documents(spark)))
    rows = sharding.slotted(sharding.records(docs), 64)
    known = [r.asDict() for r in rows.collect()]
    for r in known:
        text = next(d["text"] for d in docs.filter(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]))).collect() if zlib.crc32((d["text"] or "").encode()) == r["text_crc32"])
        assert r["size"] == len((text or "").encode()) + 1
    numbers = collections.Counter()
    hashed = spark.createDataFrame(
        [(r["doc_id"], r["text_crc32"], r["size"], (numbers.update([k := (r["doc_id"], r["text_crc32"], r["size"])]) or numbers[k]) - 1, r["seq"]) for r in sorted(known, key=lambda r: r["seq"])],
        "doc_id long, text_crc32 long, size long, number long, seq long",
    ).select("seq", F.pmod(F.xxhash64(F.xxhash64("doc_id", "text_crc32", "size"), "number"), F.lit(64)).cast("int").alias("vslot"))
    assert {r["seq"]: r["vslot"] for r in hashed.collect()} == {r["seq"]: r["vslot"] for r in known}
    weight = collections.Counter()
    for r in known:
        weight[r["vslot"]] += r["size"]
    load, shard = [0] * 4, {}
    for v in sorted(range(64), key=lambda v: (-weight[v], v)):
        shard[v] = load.index(min(load))
        load[shard[v]] += weight[v]
    placed = sharding.assign(docs, 4, 64, str(tmp_path / "maps")).collect()
    assert sorted((r["doc_id"] or -1, r["vslot"], r["shard"]) for r in placed) == sorted((r["doc_id"] or -1, r["vslot"], shard[r["vslot"]]) for r in known)
    for s in range(4):
        own = sorted(((r["slot"], r["vslot"]) for r in placed if r["shard"] == s))
        assert [k for k, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)


def test_a_map_of_other_slots_or_shards_is_refused(spark, many, tmp_path):
    path = str(tmp_path / "maps")
    assert len(ids(sharding.assign(many, 16, 64, path))) == 1000
    with pytest.raises(ValueError, match="slots 0 to 127"):
        sharding.assign(many, 16, 128, path)
    with pytest.raises(ValueError, match="16 shards, not for 8"):
        sharding.assign(many, 8, 64, path)
    assert ids(sharding.assign(many, 16, 64, path)) == list(range(1000))


def test_a_crashed_save_leaves_no_map(spark, many, tmp_path):
    path = str(tmp_path / "maps")
    os.makedirs(f"{path}/part=map/attempt=dead")  # data without a version
    os.makedirs(f"{path}/_versions")
    with open(f"{path}/_versions/.000000000000.json-dead", "w") as f:
        f.write('{"version": 0')
    assert ids(sharding.assign(many, 4, 64, path)) == list(range(1000))


def test_an_edit_is_made_once(spark, many, tmp_path):
    path = str(tmp_path / "maps")
    before = {r["doc_id"]: r["shard"] for r in sharding.assign(many, 4, 256, path).collect()}
    rows = sharding.slotted(sharding.records(many), 256)
    for _ in range(2):  # the job is tried again after it was done
        sharding.add_shard(rows, path, 4, 256, token="grow to five")
    with pytest.raises(ValueError, match="has 5 shards, not 4"):
        sharding.add_shard(rows, path, 4, 256)
    after = {r["doc_id"]: r["shard"] for r in sharding.assign(many, 5, 256, path).collect()}
    assert len(after) == 1000 and versions.snapshot(spark, path).version == 1
    moved = {after[k] for k in before if before[k] != after[k]}
    assert moved == {4} and 100 < sum(s == 4 for s in after.values()) < 300
    with pytest.raises(versions.VersionConflict):
        sharding.save_map(sharding.load_map(spark, path, 0), path, 4, "again")
    assert {r["doc_id"]: r["shard"] for r in sharding.assign(many, 4, 256, path, version=0).collect()} == before


def test_a_map_that_is_not_whole_is_not_saved(spark, tmp_path):
    loads = spark.range(8).selectExpr("CAST(id AS INT) AS vslot", "id AS bytes", "1L AS rows")
    whole = sharding.first_map(loads, 3)
    for bad in (whole.filter("vslot <> 3"), whole.unionByName(whole.limit(1)), whole.unionByName(whole.withColumn("version", F.lit(1)))):
        with pytest.raises(ValueError):
            sharding.save_map(bad, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="no slot map"):
        sharding.load_map(spark, str(tmp_path / "m"))
    rows = spark.createDataFrame([(1, 1, 5, 9, 0)], "doc_id long, size long, text_crc32 long, vslot int, seq long")
    with pytest.raises(Exception, match="slot that the map lacks"):
        sharding.place(rows, whole).collect()
