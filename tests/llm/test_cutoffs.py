"""Risk-controlled cut-offs where there are labels enough: query and SQL side by side, and the promised risk on fresh labels."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from steppe.llm import quality
from steppe.llm.oracles import ORACLES


def corpus(seed: int, first: int, n: int) -> tuple[list[tuple], list[tuple]]:
    """Documents of three strata and their labels: bad ones have symbols or repeated lines, some good ones a few symbols."""
    rng, docs, labels = random.Random(seed), [], []
    for k in range(first, first + n):
        good = rng.random() < 0.85
        lang = rng.choice(["en", "en", "de", "de", None])
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(55, 70))]
        text = " ".join(words)
        kind = rng.random()
        if not good and kind < 0.5:
            text += " " + "#" * rng.randint(10, 60)
        elif not good and kind < 0.8:
            text += "\none line again" * rng.randint(2, 5)
        elif good and kind < 0.02:
            text += " " + "*" * rng.randint(1, 40)
        docs.append((k, text, lang))
        labels.append((k, int(good)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1, 0, 7000)
    frames = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(8), spark.createDataFrame(labels, "doc_id long, quality int")
    return docs, labels, frames


def judged(stats, cutoffs):
    rows = quality.judge(stats, cutoffs).select("doc_id", "_kept", F.array_join("_reasons", ",").alias("reasons")).collect()
    return {r["doc_id"]: (r["_kept"], r["reasons"]) for r in rows}


def test_query_equals_sql_where_cutoffs_exist(spark, tables):
    docs, labels, (frame, marks) = tables
    stats = quality.signals(frame)
    cutoffs = quality.calibrate(stats, marks)
    found = [r.asDict() for r in cutoffs.collect()]
    assert {r["_stratum"] for r in found} >= {"en", "de"}
    assert all(r["_cut_symbols"] is not None and r["_cut_dup_lines"] is not None for r in found if r["_stratum"] in ("en", "de"))
    got = judged(stats, cutoffs)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER)")
    for name, rows in (("documents", docs), ("labels", labels)):
        import pandas as pd

        df = pd.DataFrame(rows)  # noqa: F841
        con.execute(f"INSERT INTO {name} SELECT * FROM df")
    want = {r[0]: (r[1], r[2]) for r in con.sql(f"SELECT doc_id, kept, reasons FROM ({ORACLES['op6_quality_rules']})").fetchall()}
    assert got == want
    assert sum("symbols" in r for _, r in got.values()) > 100 and sum("dup_lines" in r for _, r in got.values()) > 50


def test_few_good_documents_go_on_fresh_labels(spark, tables):
    """The bound is on all documents of a stratum: fresh ones that nothing was fitted on keep it."""
    _, _, (frame, marks) = tables
    cutoffs = quality.calibrate(quality.signals(frame), marks)
    docs, labels = corpus(2, 10**6, 7000)
    got = judged(quality.signals(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(8)), cutoffs)
    good = dict(labels)
    for stratum in ("en", "de"):
        kept = [got[k][0] for k, _, lang in docs if lang == stratum and good[k]]
        bad = [got[k][0] for k, _, lang in docs if lang == stratum and not good[k]]
        assert 1 - sum(kept) / len(kept) <= quality.ALPHA and sum(bad) / len(bad) < 0.85


def plain_cutoffs(rows: list[dict]) -> dict:
    """Cut-offs by (stratum, rule), from the definition."""
    from math import comb

    strata, out = {r["_stratum"] for r in rows}, {}
    for stratum in strata:
        good, bad = ([r for r in rows if r["_stratum"] == stratum and r["good"] is g] for g in (True, False))
        now, choices = {}, {}
        for _, rule, cutoff in quality.steps():
            now[rule] = cutoff
            k = sum(any(r[x] > c for x, c in now.items()) for r in good)
            n, p = len(good), quality.ALPHA
            if sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > quality.DELTA / len(strata):
                break
            gain = sum(r[rule] > cutoff for r in bad) - sum(r[rule] > cutoff for r in good)
            choices.setdefault(rule, []).append((gain, cutoff))
        out |= {(stratum, rule): max(found)[1] for rule, found in choices.items() if max(found)[0] > 0}
    return out


@pytest.mark.parametrize("n", [400, 1200])
def test_cutoffs_equal_a_plain_sequence_of_tests(spark, n):
    docs, labels = corpus(3, 0, n)
    stats = quality.signals(spark.createDataFrame(docs, "doc_id long, text string, lang string")).filter("not _failed")
    good = dict(labels)
    rows = [r.asDict() | {"good": bool(good[r["doc_id"]])} for r in stats.select("doc_id", "_stratum", *[quality._ratio(r).alias(r) for r in quality.GRID]).collect()]
    found = quality.calibrate(stats, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    got = {(r["_stratum"], rule): r[f"_cut_{rule}"] for r in found for rule in quality.GRID if r[f"_cut_{rule}"] is not None}
    assert got == plain_cutoffs(rows) and got


def test_the_sequence_tightens_every_rule_in_turn():
    plan = quality.steps()
    assert [i for i, _, _ in plan] == list(range(1, len(plan) + 1)) and len(plan) == sum(map(len, quality.GRID.values()))
    for rule, cuts in quality.GRID.items():
        assert [c for _, r, c in plan if r == rule] == sorted(cuts, reverse=True)
