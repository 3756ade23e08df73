"""Signed ranks with ties against counted sign patterns, and the report of target tables."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from steppe.operators import evaluation as E
from steppe.sources import reports


def ranked(d):
    sizes = sorted(abs(x) for x in d if x)
    return [(2 * sizes.index(abs(x)) + sizes.count(abs(x)) + 1, x > 0) for x in d if x]


def counted(d):
    ranks = ranked(d)
    plus, total = sum(r for r, up in ranks if up), sum(r for r, _ in ranks)
    low = min(plus, total - plus)
    below = sum(sum(r for r, up in zip((r for r, _ in ranks), signs, strict=True) if up) <= low for signs in itertools.product((0, 1), repeat=len(ranks)))
    return min(1.0, 2 * below / 2 ** len(ranks)) if ranks else None


def got(spark, series):
    rows = [(k, float(x)) for k, d in enumerate(series) for x in d]
    return {r["k"]: r for r in E.signed_ranks(spark.createDataFrame(rows, "k int, d double"), ["k"]).collect()}


def test_exact_with_ties_and_zeros(spark):
    rng = random.Random(9)
    series = [[rng.choice([-3, -2, -1, 0, 1, 2, 4]) for _ in range(rng.randint(1, 11))] for _ in range(40)] + [[0, 0], [1], [2, 2, 2, 2], [-1, 1]]
    found = got(spark, series)
    for k, d in enumerate(series):
        want = counted(d)
        assert (found[k]["p_wilcoxon"] if k in found else None) == (None if want is None else pytest.approx(want)), d
    # known values: two tied pairs among six, and 50 untied differences still exact
    assert found[len(series) - 2]["p_wilcoxon"] == pytest.approx(2 / 16)
    fifty = got(spark, [[k if k % 3 else -k for k in range(1, 51)]])[0]
    assert 0 < fifty["p_wilcoxon"] < 0.05


def test_normal_beyond_fifty(spark):
    rng = random.Random(2)
    series = [[round(rng.gauss(0.2, 1), 1) for _ in range(n)] for n in (51, 80, 400)]
    found = got(spark, series)
    for k, d in enumerate(series):
        ranks = ranked(d)
        n, plus = len(ranks), sum(r for r, up in ranks if up) / 2
        sizes = [abs(x) for x in d if x]
        ties = sum(sizes.count(s) ** 3 - sizes.count(s) for s in set(sizes))
        z = abs(plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        if n > E.EXACT_RANKS:
            assert found[k]["p_wilcoxon"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-7)


def test_comparisons_have_a_p_for_ties(spark):
    rows = [("model", f"2001-{m:02d}-01", 1.0) for m in range(1, 11)] + [("climatology", f"2001-{m:02d}-01", 1.0 + (0.5 if m % 3 else -0.5) * (m != 4)) for m in range(1, 11)]
    frame = spark.createDataFrame(rows, "method string, date string, mae double").selectExpr("method", "CAST(date AS DATE) AS date", "mae")
    row = E.comparisons(frame, "mae").first()
    assert row["p_wilcoxon"] == pytest.approx(counted([0.5 if m % 3 else -0.5 for m in range(1, 11) if m != 4])) and row["lag1_r"] is not None


def test_the_whole_report(spark):
    base = {"n_dates": 12, "lead_months": 3, "mae_undefined": 0, "r2_undefined": 2, "model_skill_mae": None, "r2_difference": None}
    rows = [
        base | {"method": "persistence", "mae": 0.5, "r2": None, "model_skill_mae": 0.25, "r2_difference": -0.1, "n_pairs": 12, "p_t": 0.04, "p_wilcoxon": None, "p_sign": 0.5, "identical": False, "lag1_r": None},
        base | {"method": "model", "mae": 0.4, "r2": 0.3, "n_pairs": None, "p_t": None, "p_wilcoxon": None, "p_sign": None, "identical": None},
        base | {"method": "ensemble_raw", "n_dates": 0, "mae": None, "r2": None, "n_pairs": None, "p_t": None, "p_wilcoxon": None, "p_sign": None, "identical": None},
    ]
    text = reports.skill_report({"spi_3": rows, "empty": []}, 1234, notes=["Months overlap."])
    lines = text.splitlines()
    assert lines[0] == "# Skill" and "1,234 cells" in text and "## spi_3, 3 months ahead" in text and text.endswith("* Months overlap.\n")
    table = [x for x in lines if x.startswith("| ")]
    assert table[1].startswith("| model |") and "+0.250" in text and "-0.100" in text
    assert "t 0.040, Wilcoxon n/a, sign 0.500 (n = 12, r1 = n/a)" in text and "not tested (n = n/a)" in text
    assert "[1] model: r2 is not defined on 2 dates." in text
