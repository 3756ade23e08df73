"""The boosted forecaster: its first trees, held-out blocks, shuffled labels."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from steppe.config import Period, Target
from steppe.operators import model as L

SPLITS = {"train": Period.years(2001, 2003), "validation": Period(date(2004, 1, 1), date(2004, 9, 1)), "test": Period(date(2005, 1, 1), date(2005, 11, 1))}
SIZE = {"trees": 8, "depth": 3, "step": 0.3}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for cell in range(16):
        x = 0.0
        for m in range(60):
            x = 0.9 * x + rng.gauss(0, 1)
            rows.append((cell, date(2001 + m // 12, m % 12 + 1, 1), x))
    frame = spark.createDataFrame(rows, "cell_id long, date date, x double")
    return L.prepared(L.training_table(frame, ["x"], Target("x", 1), SPLITS).withColumn("fold", (F.col("cell_id") % 4).cast("int")))


@pytest.mark.parametrize("target", [Target("x", 1), Target("x", 1, "classification", 0.0)])
def test_first_trees_are_the_shorter_model(table, target):
    rows = table.withColumn("actual", (F.col("actual") < 0).cast("double")) if target.kind == "classification" else table
    train = rows.filter("split = 'train'")
    long, short = L.fit_trees(train, target, **SIZE | {"trees": 6}), L.fit_trees(train, target, **SIZE | {"trees": 3})
    cut = L.first_trees(long, 3)
    assert (long.getNumTrees, cut.getNumTrees, L.first_trees(cut, 9).getNumTrees) == (6, 3, 3)
    assert cut.numFeatures == long.numFeatures

    def values(model):
        return [(r["cell_id"], r["issue_date"], r["prediction"]) for r in L.predict(model, rows, target).orderBy("cell_id", "issue_date").collect()]

    assert values(cut) == values(short) != values(long)


def test_a_fold_is_scored_by_the_model_of_the_others(table):
    got = {r["fold"]: r for r in L.cross_validated_trees(table.drop("features"), "fold", 5, Target("x", 1), **SIZE).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for k in (0, 3):
        others, own = table.filter(F.col("fold") != k), table.filter((F.col("fold") == k) & (F.col("split") == "test"))
        model = L.fit_trees(others, Target("x", 1), **SIZE)
        actual = [(r["actual"], r["prediction"]) for r in L.predict(model, own, Target("x", 1)).collect()]
        mean = others.filter("split = 'train'").agg(F.avg("actual")).first()[0]
        mse, naive = (sum(e) / len(actual) for e in ([(a - p) ** 2 for a, p in actual], [(a - mean) ** 2 for a, _ in actual]))
        assert got[k]["n"] == len(actual) and got[k]["n_trees"] == model.getNumTrees
        assert got[k]["n_train"] == others.filter("split = 'train'").count()
        assert got[k]["mse"] == pytest.approx(mse, rel=0.02) and got[k]["mse_mean"] == pytest.approx(naive)
        assert got[k]["skill"] > 0.3
    assert got[4]["n"] == 0 and got[4]["mse"] is None and got[4]["skill"] is None


def test_skill_vanishes_on_shuffled_labels(table):
    got = {r["trial"]: r for r in L.permutation_trees(table.drop("features"), Target("x", 1), (1, 2), **SIZE | {"patience": 2}).collect()}
    assert set(got) == {"real", "shuffled-1", "shuffled-2"}
    assert got["real"]["skill"] > 0.3
    assert all(abs(got[k]["skill"]) < 0.3 and got[k]["n_train"] == got["real"]["n_train"] for k in got if k != "real")


def test_no_rows_to_fit_on(table):
    with pytest.raises(ValueError, match="no rows to fit on"):
        L.trials({"late": table.filter("split = 'test'")}, Target("x", 1))
