"""Sharding by fixed virtual slots (DataFrame functions only).

Records are hashed into a fixed number of virtual slots. Bytes are summed per
slot, and a small versioned table maps each slot to a shard. It is stored;
records are placed by a version of it that was read back, and rebalancing adds
an edited version. Records are never hashed anew.

Records that are equal in id, size and checksum are numbered, and the number
enters the hash: many repeated rows spread over all slots like any others.

Defined results: a null text weighs one byte, as an empty one does; null ids
hash like any other value; repeated rows are placed one by one, which of them
gets which place is left open; one record heavier than its shard's share makes
that shard heavy; an empty table gives no rows; further columns of the input
are ignored. A stored map is read only where it is whole: a version is made once
or not at all, and one with other slots, or never made for that many shards, is
an error, as no record may vanish or come twice.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steppe.llm.shared import let, materialize, scratch_path
from steppe.sources import versions

N_SLOTS = 4096
#: Parts in which one virtual slot is numbered, so that a hot slot is not one task.
PARTS = 4


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, h (their hash) and seq (the row) of each document, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("seq", F.monotonically_increasing_id())
    return materialize(rows, "shard-records")


def slotted(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds vslot: the hash of a record and of its number among equal ones.

    Numbers come from ranks inside each partition of the written table and
    counts of the partitions before it, so no group of equal rows is one task.
    """
    many = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shard-repeated")
    again = rows.join(many.hint("merge"), "h", "left_semi").withColumn("pid", F.shiftright("seq", 33))
    before = Window.partitionBy("h").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = again.groupBy("h", "pid").agg(F.count("*").alias("n"))
    base = base.select("h", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("h", "pid").orderBy("seq"))
    again = again.withColumn("rank", rank).join(base, ["h", "pid"]).withColumn("number", F.col("base") + F.col("rank") - 1)
    once = rows.join(many.hint("merge"), "h", "left_anti").withColumn("number", F.lit(0).cast("long"))
    names = ["doc_id", "size", "text_crc32", "seq"]
    vslot = F.pmod(F.xxhash64("h", "number"), F.lit(n_slots)).cast("int").alias("vslot")
    return materialize(once.select(*names, vslot).unionByName(again.select(*names, vslot)), "shard-rows")


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Bytes and rows of each virtual slot, empty ones too: ``n_slots`` rows."""
    loads = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    found = every.join(loads, "vslot", "left")
    return found.select("vslot", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "rows")])


def first_map(loads: DataFrame, n_shards: int) -> DataFrame:
    """Version 0 of the map: heaviest slot first, each to the lightest shard.

    The one row that is folded here holds the slots, never records, so its
    size is bounded by the number of virtual slots.
    """
    slot = F.struct((-F.col("bytes")).alias("weight"), "vslot")
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), n_shards).alias("load"),
        F.array().cast("array<struct<vslot:int,shard:int>>").alias("placed"),
    )

    def place(acc, s):
        return let(
            (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int"),
            lambda k: F.struct(
                F.transform(acc["load"], lambda x, i: F.when(i == k, x - s["weight"]).otherwise(x)).alias("load"),
                F.concat(acc["placed"], F.array(F.struct(s["vslot"].alias("vslot"), k.alias("shard")))).alias("placed"),
            ),
        )

    folded = loads.groupBy().agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    placed = folded.select(F.explode(F.aggregate("slots", start, place, lambda acc: acc["placed"])).alias("p"))
    return placed.select(F.lit(0).alias("version"), "p.vslot", "p.shard")


def grow_map(slot_map: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version, for one shard more than ``n_shards``.

    Each shard gives away the first of its slots up to its share of bytes; all
    other slots stay, so only what the new shard receives is moved.
    """
    by = Window.partitionBy("shard")
    moved = F.sum("bytes").over(by.orderBy("vslot")) * (n_shards + 1) <= F.sum("bytes").over(by)
    return (
        slot_map.join(loads, "vslot")
        .select(
            (F.col("version") + 1).alias("version"),
            "vslot",
            F.when(moved, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
        )
    )


def save_map(slot_map: DataFrame, path: str, n_shards: int | None = None, token: str | None = None) -> int:
    """Adds a version to the stored map, once or not at all; versions that are there stay as they are.

    A version is the number that the rows of the map say. Writing it again with
    the same ``token`` (a retried job) adds nothing; another writer's version of
    that number is an error. ``n_shards`` is noted beside it; without it, the
    shards that have slots count.
    """
    rows = materialize(slot_map.select("vslot", "shard", "version").coalesce(1), "slot-map")
    n, first, last = rows.agg(F.count("*"), F.min("version"), F.max("version")).collect()[0]
    if not n or first != last:
        raise ValueError(f"a map has one version, not {first} to {last}")
    most = _checked(rows, n, f"version {first}")
    notes = {"map": str(most + 1 if n_shards is None else n_shards)}
    return versions.commit(slot_map.sparkSession, path, {"map": rows}, notes, first, token or f"map-{first}").version


def _checked(slot_map: DataFrame, n_slots: int, what: str) -> int:
    """The last shard of a map that has every slot from 0 to ``n_slots`` once; else an error. A map's size is that of the slots, not of the data."""
    n, slots, first, last, known, least, most = slot_map.agg(
        F.count("*"), F.count_distinct("vslot"), F.min("vslot"), F.max("vslot"), F.count("shard"), F.min("shard"), F.max("shard")
    ).collect()[0]
    if not n == slots == known == n_slots or first != 0 or last != n_slots - 1 or least < 0:
        raise ValueError(f"{what} has not each of the slots 0 to {n_slots - 1} once")
    return most


def n_shards_of(spark: SparkSession, path: str, version: int | None = None) -> int:
    """The number of shards that a version of the stored map places on."""
    found = versions.snapshot(spark, path, version)
    if found is None:
        raise ValueError(f"no slot map at {path}")
    return int(found.parts["map"].note)


def load_map(spark: SparkSession, path: str, version: int | None = None, n_slots: int | None = None) -> DataFrame:
    """A version of the stored map, the latest if none is given; an error if it is not whole, or of another number of slots."""
    shards = n_shards_of(spark, path, version)
    found = versions.read(spark, path, "vslot int, shard int, version int", version).select("version", "vslot", "shard")
    if _checked(found, n_slots or found.count(), f"the map at {path}") >= shards:
        raise ValueError(f"the map at {path} places slots beyond its {shards} shards")
    return found


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless position of each slotted record, by a map.

    One narrow shuffle numbers the rows within parts of virtual slots; where a
    part begins in its shard follows from a running sum over the table of
    parts, which has ``PARTS`` rows a slot at most and so may be broadcast.
    """
    rows = rows.withColumn("part", F.pmod("seq", F.lit(PARTS)).cast("int"))
    parts = rows.groupBy("vslot", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.join(slot_map, "vslot", "left").withColumn("shard", F.coalesce("shard", F.raise_error(F.lit("a record has a slot that the map lacks")).cast("int")))
    base = base.select("vslot", "part", "version", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "seq"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(base), ["vslot", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "vslot",
            F.col("version").alias("map_version"),
            "shard",
            (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"),
        )
    )


def assign(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, path: str | None = None, version: int | None = None) -> DataFrame:
    """Place each document by the map stored at ``path``, which is made for ``n_shards`` if there is none yet.

    Shards are those of the map, which may have grown; a map that was never one
    of ``n_shards``, or has other slots, is an error.
    Output: doc_id, size, text_crc32, vslot, map_version, shard, slot.
    """
    spark = docs.sparkSession
    rows = slotted(records(docs), n_slots)
    path = path or scratch_path(spark, "slot-maps")
    if versions.snapshot(spark, path) is None:
        with contextlib.suppress(versions.VersionConflict):  # another job made the first map meanwhile: that one holds
            save_map(first_map(slot_loads(rows, n_slots), n_shards), path, n_shards, uuid.uuid4().hex)
    if not n_shards_of(spark, path, 0) <= n_shards <= n_shards_of(spark, path):
        raise ValueError(f"the map at {path} is for {n_shards_of(spark, path)} shards, not for {n_shards}")
    return place(rows, load_map(spark, path, version, n_slots))


def add_shard(rows: DataFrame, path: str, n_shards: int, n_slots: int = N_SLOTS, token: str | None = None) -> None:
    """Edits the stored map of ``n_shards`` for one shard more, by the present loads of the slots.

    With a ``token`` the edit can be tried again: it is made once. Without one,
    the second try finds a map of another number of shards, an error.
    """
    spark = rows.sparkSession
    now = versions.snapshot(spark, path)
    if token is not None and now is not None and now.token == token:
        return
    if n_shards_of(spark, path) != n_shards:
        raise ValueError(f"the map at {path} has {n_shards_of(spark, path)} shards, not {n_shards}")
    grown = grow_map(load_map(spark, path, None, n_slots), slot_loads(rows, n_slots), n_shards)
    save_map(grown, path, n_shards + 1, token or uuid.uuid4().hex)
