"""Messages and crawl records with repeated and null ids, against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from steppe.llm import chat, warc

MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def branches(spark, rows, **how):
    done = chat.format_trees(spark.createDataFrame(rows, MESSAGES), branches=None, **how)
    rows = done.select("tree", "leaf", chat.parse_formatted(F.col("formatted")).alias("turns")).collect()
    return sorted(((r["tree"], r["leaf"], "".join(t["text"] for t in r["turns"])) for r in rows), key=repr)


def test_a_message_listed_twice_counts_once(spark):
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 0.0), (1, 2, 1, "assistant", "b", 0.0), (1, 3, 2, "user", "c", 0.0), (1, 1, None, "user", "z", 0.0)]
    assert branches(spark, rows) == [(1, 3, "abc")]
    assert branches(spark, [rows[0], rows[1], rows[3]], clean_ids=True) == [(1, 3, "abc")]


def test_null_trees_and_nodes(spark):
    rows = [
        (None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "b", 0.0), (1, 1, None, "user", "c", 0.0), (1, None, 1, "assistant", "d", 0.0),
        (1, None, 1, "assistant", "d", 0.0), (1, None, None, "user", "e", 0.0), (2, 5, 9, "user", "f", None),
    ]
    assert branches(spark, rows) == sorted([(None, 2, "ab"), (1, None, "cd"), (1, None, "cd"), (1, None, "e"), (2, 5, "f")], key=repr)


def plain(records):
    out = []
    for rid, kind, url, time, _ in records:
        if kind == "revisit":
            fits = [(t, -1 if i is None else i, h) for i, k, u, t, h in records if k == "response" and u == url and u is not None and t is not None and time is not None and t < time]
            out.append((rid, url, time, max(fits)[2]["etag"] if fits else None))
    return sorted(out, key=repr)


def test_revisits_that_share_ids_or_lack_them(spark):
    rng = random.Random(6)
    records = [(9, "revisit", "a", 50, {}), (9, "revisit", "b", 60, {}), (None, "revisit", "a", 70, {}), (None, "revisit", "b", None, {}), (1, "response", "b", None, {"etag": "none"})]
    records += [(rng.choice([1, 2, 3, None]), rng.choice(["response", "revisit"]), rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 99)]), {"etag": f"e{k}"}) for k in range(150)]
    records = [(i, k, u, t, h if k == "response" else {}) for i, k, u, t, h in records]
    seen, unique = set(), []  # responses of one url, time and id would tie
    for r in records:
        if r[1] == "revisit" or (r[0], r[2], r[3]) not in seen:
            seen.add((r[0], r[2], r[3]))
            unique.append(r)
    frame = spark.createDataFrame([(*r[:4], r[4], f"digest {r[4].get('etag')}") for r in unique], "record_id long, kind string, url string, time long, headers map<string,string>, payload_digest string")
    done = warc.resolve(frame.withColumn("headers", F.when(F.col("kind") == "response", F.col("headers")).otherwise(F.create_map(F.lit("etag"), F.lit("x")))), span=16)
    got = done.collect()
    want = plain(unique)
    assert len(got) == len(want)
    assert sorted(((r["record_id"], r["key"], r["time"], r["status"]) for r in got), key=repr) == sorted(((i, u, t, "mismatch" if e else "orphan") for i, u, t, e in want), key=repr)
    weak = frame.withColumn("headers", F.when(F.col("kind") == "response", F.map_concat(F.map_filter("headers", lambda k, v: k != "etag"), F.create_map(F.lit("x-etag"), F.col("headers")["etag"], F.lit("etag"), F.lit("x")))).otherwise(F.create_map(F.lit("etag"), F.lit("x"))))
    merged = sorted(((r["record_id"], r["key"], r["time"], r["headers"].get("x-etag")) for r in warc.resolve(weak, span=16).collect()), key=repr)
    assert merged == want
