"""Operators on small literal tables with answers worked out by hand."""

from __future__ import annotations

import json
import math
import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from steppe.config import Period, Target
from steppe.functions import distributions as D
from steppe.functions import geo
from steppe.functions.calendar import month_sin, year_month
from steppe.operators import baselines as B
from steppe.operators import indices as X
from steppe.operators import integrity as Q
from steppe.operators import metrics as M
from steppe.operators import model as L
from steppe.operators import panel as P
from steppe.operators import significance as S
from steppe.operators import windows as W
from steppe.operators import zeros as Z
from steppe.sources import readers as R
from steppe.sources import reports
from steppe.streaming import accumulate as stream

YEARS = Period.years(2001, 2003)


def series(spark, values, start=(2001, 1), cell=1, name="x"):
    first = start[0] * 12 + start[1] - 1
    rows = [(cell, date((first + i) // 12, (first + i) % 12 + 1, 1), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"cell_id long, date date, {name} double")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("date",))).collect()]


# functions


def test_normal_quantile_and_distribution(spark):
    ps = [1e-9, 0.001, 0.02, 0.1, 0.5, 0.7, 0.975, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double")
    got = {r["p"]: (r["z"], r["b"]) for r in rows.select("p", D.norm_ppf(F.col("p")).alias("z"), D.norm_cdf(D.norm_ppf(F.col("p"))).alias("b")).collect()}
    for p in ps:
        assert got[p][0] == pytest.approx(statistics.NormalDist().inv_cdf(p), rel=1e-9, abs=1e-12)
        assert got[p][1] == pytest.approx(p, rel=1e-6)
    assert got[0.0][0] is None and got[1.0][0] is None


def test_incomplete_gamma_against_commons_math(spark):
    gamma = spark._jvm.org.apache.commons.math3.special.Gamma
    cases = [(a, a * k) for a in (0.3, 0.5, 1.0, 7.5, 100.0, 450.0) for k in (0.01, 0.3, 0.9, 1.0, 1.1, 2.0, 3.0)]
    rows = spark.createDataFrame(cases, "a double, x double")
    for r in rows.select("a", "x", D.gamma_p(F.col("a"), F.col("x")).alias("p"), D.log_gamma(F.col("a")).alias("l")).collect():
        assert r["p"] == pytest.approx(gamma.regularizedGammaP(r["a"], r["x"]), abs=1e-10)
        assert r["l"] == pytest.approx(math.lgamma(r["a"]), abs=1e-9)
    edge = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (None, 1.0), (1.0, None)], "a double, x double")
    assert [r["p"] for r in edge.select(D.gamma_p(F.col("a"), F.col("x")).alias("p")).collect()] == [0.0, None, None, None]


def test_incomplete_gamma_of_large_shapes_and_values(spark):
    rows = [(0.5, 1e9), (3.0, 1e6), (2e6, 2e6), (2e6, 2e6 + 1500), (5e11, 5e11 - 1e6), (5e11, 6e11), (2e6, 1.0)]
    frame = spark.createDataFrame(rows, "a double, x double")
    got = [r["p"] for r in frame.select(D.gamma_p(F.col("a"), F.col("x")).alias("p")).collect()]
    want = [1.0, 1.0, *(statistics.NormalDist().cdf(3 * math.sqrt(a) * ((x / a) ** (1 / 3) - 1 + 1 / (9 * a))) for a, x in rows[2:5]), 1.0, 0.0]
    assert got == pytest.approx(want, abs=1e-9)
    assert got[2] == pytest.approx(0.5 + 1 / (3 * math.sqrt(2 * math.pi * 2e6)), abs=1e-7)


def test_gamma_quantile_inverts_the_distribution(spark):
    cases = [(p, a) for p in (0.001, 0.1587, 0.5, 0.99) for a in (0.3, 1.0, 5.0, 80.0)]
    rows = spark.createDataFrame(cases, "p double, a double").withColumn("x", D.gamma_ppf(F.col("p"), F.col("a"), F.lit(2.0)))
    for r in rows.select("p", D.gamma_p(F.col("a"), F.col("x") / 2).alias("b")).collect():
        assert r["b"] == pytest.approx(r["p"], rel=1e-8)


def test_digamma(spark):
    gamma = spark._jvm.org.apache.commons.math3.special.Gamma
    for r in spark.createDataFrame([(x,) for x in (0.2, 1.0, 3.7, 60.0)], "x double").select("x", D.digamma(F.col("x")).alias("d"), D.trigamma(F.col("x")).alias("t")).collect():
        assert r["d"] == pytest.approx(gamma.digamma(r["x"]), abs=1e-7)
        assert r["t"] == pytest.approx(gamma.trigamma(r["x"]), abs=1e-6)


def test_cell_ids_and_lattice(spark):
    row = spark.range(1).select(geo.cell_id(F.lit(4251.0), F.lit(440.0)).alias("c"))
    row = row.select("c", geo.cell_i(F.col("c")).alias("i"), geo.cell_j(F.col("c")).alias("j"))
    assert tuple(row.first()) == (425100440, 4251, 440)
    assert geo.lattice_params([0.05, 0, -180.0, 0, -0.05, 50.0]) == (0.05, -180.0, 50.0)
    with pytest.raises(ValueError):
        geo.lattice_params([0.05, 0, 0, 0, 0.05, 0])


def test_haversine_and_features(spark):
    km = spark.range(1).select(geo.haversine_km(F.lit(32.5), F.lit(37.9), F.lit(32.85), F.lit(39.93)).alias("k")).first()["k"]
    assert km == pytest.approx(227.8, abs=1)
    cell = spark.createDataFrame([(1, 30.0, 40.0, 0.5)], "cell_id long, lon double, lat double, crop double")
    feature = json.loads(geo.features(cell, 0.025, ["cell_id", "crop"]).first()["feature"])
    (ring,) = feature["geometry"]["coordinates"]
    assert len(ring) == 5 and ring[0] == ring[-1] and feature["properties"] == {"cell_id": 1, "crop": 0.5}


def test_geojson_file_and_polygon(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 0.5)], "cell_id long, lon double, lat double")
    geo.write_geojson(cells, str(tmp_path / "g.json"), 0.1, ["cell_id"])
    assert len(json.load(open(tmp_path / "g.json"))["features"]) == 2
    inside = cells.filter(geo.in_polygon(F.col("lon"), F.col("lat"), [(0, 0), (1, 0), (1, 1), (0, 1)]))
    assert column(inside, "cell_id", "cell_id") == [1]


def test_calendar(spark):
    row = spark.range(1).select(year_month(F.lit(-1)).alias("m"), month_sin(F.lit(date(2001, 3, 1))).alias("s")).first()
    assert row["m"] == "1969-12" and row["s"] == pytest.approx(1.0)


# panel


def test_spine_and_densify(spark):
    rows = series(spark, [1, 2], cell=1).unionByName(series(spark, [5], (2001, 3), cell=2))
    full = P.densify(rows, date(2001, 1, 1), date(2001, 3, 1))
    assert full.count() == 6 and P.missing_months(full, "x") == 3
    assert P.densify(rows, date(2001, 1, 1), date(2001, 3, 1), {"x": 0.0}).filter("x = 0").count() == 3


def test_outer_join_keeps_missing_keys_and_rejects_repeats(spark):
    a, b = series(spark, [1, 2, 3]), series(spark, [4], (2001, 2), name="y")
    joined = P.outer_one_to_one(a, b)
    assert column(joined, "y") == [None, 4.0, None]
    with pytest.raises(ValueError):
        P.outer_one_to_one(a.unionByName(a), b)
    assert P.duplicate_rows(a.unionByName(a), P.KEYS) == 3
    assert {r["side"]: r["n"] for r in P.key_differences(a, b, P.KEYS).collect()} == {"left": 2}


def test_population_and_membership(spark):
    cells = spark.createDataFrame([(1, True, False, 0.5), (2, True, True, 0.9), (3, False, False, 0.9), (4, True, False, 0.4)], "cell_id long, in_basin boolean, in_lobe boolean, crop_frac double")
    population = P.analysis_population(cells)
    assert column(population, "cell_id", "cell_id") == [1]
    assert [tuple(r) for r in P.with_membership(cells.select("cell_id"), population, "m").orderBy("cell_id").collect()] == [(1, True), (2, False), (3, False), (4, False)]


def test_level_shift(spark):
    rows = spark.createDataFrame([(1980 + i, float(100 + (i * 7) % 40)) for i in range(45)], "year int, annual_mean double")
    assert P.level_shift_ok(rows, 2021)
    shifted = rows.withColumn("annual_mean", F.when(F.col("year") > 2010, 10.0).otherwise(F.col("annual_mean")))
    assert not P.level_shift_ok(shifted, 2021)


# windows


def test_rolling_and_centred(spark):
    assert column(series(spark, [1, 2, 3, 4]).withColumn("r", W.rolling_sum("x", 3)), "r") == [None, None, 6.0, 9.0]
    centred = column(series(spark, range(20)).withColumn("c", W.centred_mean("x")), "c")
    assert centred[:7] == [None] * 6 + [5.5] and centred[14] == 13.5 and centred[15:] == [None] * 5


def test_lags_leads_and_calendar(spark):
    rows = series(spark, range(20)).withColumn("x", F.when(F.month("date") == 99, 0.0).otherwise(F.col("x")))
    lagged = W.lag_features(rows, ["x"])
    assert len(lagged.columns) == 2 + 5 + 2 and column(lagged, "x_lag6")[6] == 0.0
    gap = rows.filter("date <> DATE '2001-05-01'")
    assert column(W.calendar_shift(gap, "x", 1, "p"), "p")[4] is None
    assert column(gap.withColumn("p", F.lag("x").over(W.by_cell())), "p")[4] == 3.0


def test_features_never_see_the_future(spark):
    rows = series(spark, [999999.0 if i == 15 else i for i in range(20)])
    before = W.lag_features(rows, ["x"]).filter("date < DATE '2002-04-01'")
    assert before.filter(" OR ".join(f"x_lag{k} = 999999.0" for k in W.LAGS)).count() == 0


def test_below_keeps_nulls(spark):
    assert column(series(spark, [None, -2, 0]).withColumn("b", W.below(F.col("x"), -1)), "b") == [None, True, False]


def test_autocorrelation_needs_four_dates_and_variation(spark):
    for values, want in (([1, 2, 1], None), ([3, 3, 3, 3, 3], None), ([1, 2, 3, 4, 5], 1.0)):
        got = W.autocorrelation(series(spark, values), ["cell_id"], "x").first()["lag1_r"]
        assert got == (None if want is None else pytest.approx(want))


# indices


def yearly(spark, values):
    """The values as the Januaries of consecutive years."""
    rows = [(1, date(2001 + i, 1, 1), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell_id long, date date, amount double")


@pytest.mark.parametrize("values", [[1, 2, 3, 4], [0] * 6 + [1, 2, 3, 4], [3] * 5, [None] * 5])
def test_fits_that_must_be_null(spark, values):
    rows = X.gamma_fit(yearly(spark, values), Period.years(2001, 2020)).collect()
    assert all(r["shape"] is None and r["q"] is None for r in rows)


def test_gamma_fit_recovers_parameters_and_mle_is_better(spark):
    rng = random.Random(3)
    values = [rng.gammavariate(2.5, 40.0) for _ in range(3000)] + [0.0] * 300
    rows = [(1, date(1000 + i // 12, 1, 1), v) for i, v in enumerate(values)]
    amounts = spark.createDataFrame(rows, "cell_id long, date date, amount double")
    fit = Period.years(1000, 2000)
    thom, mle = (X.gamma_fit(amounts, fit, estimator=e).first() for e in ("thom", "mle"))
    assert thom["q"] == pytest.approx(300 / 3300)
    for r in (thom, mle):
        assert r["shape"] == pytest.approx(2.5, rel=0.06) and r["scale"] == pytest.approx(40.0, rel=0.08)
    positive = [v for v in values if v > 0]
    s = math.log(statistics.fmean(positive)) - statistics.fmean(map(math.log, positive))
    gamma = spark._jvm.org.apache.commons.math3.special.Gamma
    assert math.log(mle["shape"]) - gamma.digamma(mle["shape"]) == pytest.approx(s, abs=1e-7)


def test_spi_of_zeros_medians_and_missing_fits(spark):
    values = [0, 0, 5, 10, 20, 30, 40, 60, None]
    amounts = yearly(spark, values)
    params = X.gamma_fit(amounts, Period.years(2001, 2009))
    got = column(X.spi(amounts, params, "z"), "z")
    assert got[0] == pytest.approx(statistics.NormalDist().inv_cdf(2 / 8), abs=1e-6) and got[8] is None
    assert got[2:8] == sorted(got[2:8])
    other = amounts.withColumn("cell_id", F.lit(2).cast("long"))
    assert column(X.spi(other, params, "z"), "z") == [None] * 9


def test_spi_ignores_years_outside_the_fit(spark):
    values = [5, 10, 20, 30, 40, 60, 70, 80]
    fit = Period.years(2001, 2006)

    def run(rows):
        a = rows.select("cell_id", "date", "amount")
        return X.gamma_fit(a, fit)

    assert Q.unchanged(run, yearly(spark, values), "amount", F.year("date") > 2006)


def test_sensitivity_reads_the_same_fit(spark):
    params = spark.createDataFrame([(1, 1, 0.0, 2.0, 30.0), (1, 2, 0.3, 2.0, 30.0), (1, 3, 0.6, 2.0, 30.0), (1, 4, None, None, None)], "cell_id long, month int, q double, shape double, scale double")
    got = column(X.sensitivity(params), "mm_per_unit", "month")
    gamma = spark._jvm.org.apache.commons.math3.distribution.GammaDistribution(2.0, 30.0)
    inverse = gamma.inverseCumulativeProbability
    assert got[0] == pytest.approx(inverse(0.5) - inverse(X.PHI_MINUS_ONE), rel=1e-6)
    assert got[1] == pytest.approx(inverse(0.2 / 0.7), rel=1e-6)
    assert got[2] == 0.0 and got[3] is None


def test_spei_is_standard_normal_on_its_fit(spark):
    rng = random.Random(5)
    rows = [(1, date(1901 + i, 1, 1), rng.gauss(50, 20), 40.0) for i in range(90)]
    frame = spark.createDataFrame(rows, "cell_id long, date date, p double, e double")
    got = [v for v in column(X.spei(frame, "p", "e", 1, Period.years(1901, 1990)), "spei_1") if v is not None]
    assert len(got) == 90 and abs(statistics.fmean(got)) < 0.1 and statistics.stdev(got) == pytest.approx(1, abs=0.1)


def test_evapotranspiration(spark):
    row = spark.range(1).select(X.reference_evapotranspiration(F.lit(21.5), F.lit(12.3), F.lit(11.0), F.lit(2.078), F.lit(13.28), F.lit(100.1)).alias("e")).first()["e"]
    assert row["mm"] == pytest.approx(3.9, abs=0.4) and row["clamped"] is False


# baselines


def test_climatology_uses_fit_years_only(spark):
    rows = series(spark, [float(i % 12) for i in range(60)])
    fit = Period.years(2001, 2003)
    assert Q.unchanged(lambda p: B.climatology(p, "x", fit), rows, "x", F.year("date") > 2003)
    assert not Q.unchanged(lambda p: B.climatology(p, "x", fit), rows, "x", F.year("date") == 2002)
    assert column(B.climatology(rows, "x", fit), "climatology")[-1] == 11.0


def test_rates_skip_nulls_unless_told(spark):
    rows = yearly(spark, [1, None, 9]).withColumnRenamed("amount", "x")
    fit = Period.years(2001, 2003)
    assert column(B.climatology_probability(rows, "x", 5, fit), "climatology_prob")[0] == 0.5
    assert column(B.climatology_probability(rows, "x", 5, fit, null_as_false=True), "climatology_prob")[0] == pytest.approx(1 / 3)


def test_persistence_and_transition(spark):
    rows = series(spark, [1, 9, 1, 9, 1, 9, 1, 9])
    assert column(B.persistence(rows, "x", 3), "persistence")[:4] == [None, None, None, 1.0]
    table = B.transition_table(rows, "x", 1, 5, Period(date(2001, 1, 1), date(2001, 6, 1)))
    assert {r["now"]: (r["rate"], r["n"]) for r in table.collect()} == {True: (0.0, 3), False: (1.0, 2)}
    assert column(B.persistence_probability(rows, "x", 1, 5, table), "persistence_prob")[:3] == [None, 0.0, 1.0]
    B.require_both_states(table)
    with pytest.raises(ValueError):
        B.require_both_states(B.transition_table(series(spark, [9] * 6), "x", 1, 5, YEARS))


def test_transition_pairs_end_inside_the_fit(spark):
    rows = series(spark, [float(i % 5) for i in range(48)])
    fit = Period.years(2001, 2003)
    assert Q.unchanged(lambda p: B.transition_table(p, "x", 3, 2, fit), rows, "x", (F.year("date") == 2004))


def test_known_accumulation(spark):
    rows = series(spark, [float(i) for i in range(36)])
    fit = Period.years(2001, 2003)
    got = column(B.known_accumulation(rows, "x", 3, 1, fit), "known_accumulation")
    assert got[:2] == [None, None] and got[14] == pytest.approx(13 + 12 + 14)
    whole = column(B.known_accumulation(rows, "x", 3, 3, fit), "known_accumulation")
    assert whole[14] == pytest.approx((3 + (12 + 13 + 14) + (24 + 25 + 26)) / 3)


def test_baseline_table_keeps_unavailable_forecasts(spark):
    rows = series(spark, [float(i % 7) for i in range(36)], name="spi_3")
    out = B.build(rows, Target("spi_3", 3, "classification", 3.0), YEARS)
    assert out.count() == 36 and out.filter("ensemble_raw IS NOT NULL OR ensemble_raw_prob IS NOT NULL").count() == 0
    assert out.filter("climatology = known_accumulation").count() == 36
    assert "actual_prob" not in B.build(rows, Target("spi_3", 3), YEARS).columns


# scores


def scored(spark, actual, forecast):
    return spark.createDataFrame([(date(2001, 1, 1), a, f) for a, f in zip(actual, forecast, strict=True)], "date date, a double, f double")


def test_regression_scores(spark):
    r = M.regression_by_date(scored(spark, [1.0, 2.0, 3.0, None], [1.0, 3.0, 2.0, 9.0]), "a", "f", min_rows=3).first()
    assert (r["n"], r["mae"], r["r2"]) == (3, pytest.approx(2 / 3), pytest.approx(0.0))
    assert M.regression_by_date(scored(spark, [2.0] * 3, [1.0] * 3), "a", "f", min_rows=3).first()["r2"] is None
    assert M.regression_by_date(scored(spark, [2.0] * 9, [1.0] * 9), "a", "f").count() == 0


def test_auc_with_ties_and_one_class(spark):
    assert M.auc_by_date(scored(spark, [0.0, 0.0, 1.0, 1.0], [0.1, 0.5, 0.5, 0.9]), "a", "f", min_rows=1).first()["auc"] == 0.875
    one = scored(spark, [1.0] * 4, [0.1, 0.2, 0.3, 0.4])
    assert M.auc_by_date(one, "a", "f", min_rows=1).first()["auc"] is None
    assert M.brier_by_date(one, "a", "f", min_rows=1).first()["brier"] == pytest.approx((0.81 + 0.64 + 0.49 + 0.36) / 4)


def test_skill_scores(spark):
    rows = spark.createDataFrame([(0.8, 1.0), (0.8, 0.0), (0.8, None)], "m double, b double")
    assert [r["s"] for r in rows.select(M.skill_score(F.col("m"), F.col("b")).alias("s")).collect()] == [pytest.approx(0.2), None, None]


def test_paired_statistics_and_p_values(spark):
    days = [date(2001, m, 1) for m in range(1, 9)]
    model = spark.createDataFrame([(d, 1.0 + 0.1 * i) for i, d in enumerate(days)], "date date, mae double")
    better = spark.createDataFrame([(d, 1.0 + 0.1 * i + x) for i, (d, x) in enumerate(zip(days, [0.3, 0.1, -0.2, 0.5, 0.4, 0.6, 0.7, 0.8], strict=True))], "date date, mae double")
    pairs = M.paired(model, better, "mae")
    differences = column(pairs, "d")
    out = S.paired_test(spark, M.paired_statistics(pairs), differences)
    assert (out["wins"], out["losses"], out["w_plus"]) == (7, 1, 34.0)
    assert out["p_sign"] == pytest.approx(0.0703125) and out["p_wilcoxon"] == pytest.approx(0.0234375)
    t = statistics.fmean(differences) / (statistics.stdev(differences) / math.sqrt(8))
    assert out["t"] == pytest.approx(t) and 0.01 < out["p_t"] < 0.03
    same = S.paired_test(spark, M.paired_statistics(M.paired(model, model, "mae")), [0.0] * 8)
    assert same["identical"] and same["p_t"] is None and same["p_wilcoxon"] is None


def test_verification_is_issue_plus_lead(spark):
    rows = spark.createDataFrame([(1, date(2023, 1, 1), 3)], "cell_id long, issue_date date, lead_months int")
    assert M.issue_to_verification(rows).first()["verification_date"] == date(2023, 4, 1)


def test_reliability_and_bins(spark):
    rows = scored(spark, [0.0, 1.0, 1.0, 0.0], [0.05, 0.95, 1.0, 0.5])
    assert {r["bin"]: r["n"] for r in M.reliability(rows, "a", "f").collect()} == {0: 1, 9: 2, 5: 1}
    bins = spark.createDataFrame([(1.0,), (5.0,), (12.0,), (20.0,), (None,)], "x double").select(M.sensitivity_bin(F.col("x")).alias("b"))
    assert [r["b"] for r in bins.collect()] == ["0-5", "5-10", "10-20", ">=20", None]


# integrity


def test_digest_survives_joins_and_sees_changes(spark):
    rows = series(spark, [1, None, 3])
    other = series(spark, [1], (2002, 1), name="y")
    before = Q.digest(rows, ["x"])
    assert Q.digest_differences(before, Q.digest(rows.join(other, P.KEYS, "full").repartition(3), ["x"])).isEmpty()
    assert not Q.digest_differences(before, Q.digest(rows.withColumn("x", F.col("x") + 1), ["x"])).isEmpty()


def test_gate_and_expectations(spark):
    good, bad = Q.Expectation("rows", 3, 3), Q.Expectation("nulls", 0, 2)
    Q.gate([good])
    with pytest.raises(ValueError, match="nulls"):
        Q.gate([good, bad])
    assert [r["ok"] for r in Q.as_frame(spark, [good, bad]).collect()] == [True, False]


def test_physical_rules_and_audits(spark):
    row = dict(t2m_min_c=1.0, t2m_c=2.0, t2m_max_c=3.0, dewpoint_c=5.0, wind10m_ms=1.0, srad_down_mj_m2_day=10.0, surface_pressure_kpa=90.0, swvl1=None, swvl2=0.3, swvl3=1.2, swvl4=0.1, precip_era5_mm=0.0)
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    assert {r["rule"]: r["n_violations"] for r in Q.violations(frame, Q.physical_rules()).collect() if r["n_violations"]} == {"dew_point": 1, "soil": 1}
    assert [tuple(r) for r in Q.null_audit(series(spark, [1, None, 3]), ["x"]).collect()] == [("x", 1, 1.0, 3.0)]
    assert Q.static_null_sets(series(spark, [1, None, 3]), "x") == 2
    manifests = spark.createDataFrame([("a", "1", False), ("a", "2", False), ("b", None, False), ("c", "1", True), ("d", "1", False)], "source string, producer_digest string, producers_dirty boolean")
    assert column(Q.one_producer(manifests), "source", "source") == ["a", "b", "c"]


def test_checks_of_predictions_and_schemas(spark):
    rows = spark.createDataFrame([(0.0, 0.2), (1.0, 1.5), (0.5, None), (None, 0.1)], "a double, p double")
    assert tuple(Q.prediction_checks(rows, "a", "p").first()) == (1, 1, 1)
    assert Q.schema_problems([("a", "double"), ("b_x", "int")], {"a": "double", "c": "int"}) == ["b_x: suffix", "c: missing for int"]
    both = spark.createDataFrame([(True, 0.4), (True, 0.4), (True, None), (False, 0.2)], "now boolean, p double")
    assert tuple(Q.persistence_order(both, F.col("now"), "p").first()) == (0.4, 0.2, True)
    annual, reference = spark.createDataFrame([(2001, 100.0), (2002, 3000.0)], "year int, annual_mean double"), spark.createDataFrame([(2001, 101.0)], "year int, annual_mean double")
    assert {r["year"]: (r["within"], r["possible"]) for r in Q.drift(annual, reference).collect()} == {2001: (True, True), 2002: (False, False)}


def test_products(spark):
    from steppe.operators import products as R2

    rows = series(spark, [1, None, 3])
    assert column(R2.availability(rows, ["x"]), "x_available", "date") == [True, False, True]
    assert [tuple(r) for r in R2.reference_columns(rows, {"x": "1981-2016", "other": "2001-2016"}).collect()] == [("x", "1981-2016")]
    members = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)] + [(2, None)], "k int, v double")
    got = {r["k"]: r for r in R2.ensemble(members, ["k"], "v").collect()}
    assert (got[1]["n_members"], got[1]["mean"], got[1]["lower_tercile"], got[1]["upper_tercile"]) == (4, 2.5, 2.0, 3.0)
    assert got[2]["n_members"] == 0 and got[2]["mean"] is None
    bias = R2.bias_table(series(spark, [2, 4]), series(spark, [1, 1]), ["cell_id", "date"], "x", [F.col("cell_id")])
    assert tuple(bias.first()) == (1, 2.0, 2)
    assert column(R2.unbiased(series(spark, [2, 4]), bias, ["cell_id"], "x"), "x", "date") == [0.0, 2.0]


def test_masked_pixels_give_up_their_weight(spark):
    points = spark.createDataFrame([(1, 1.0, 9.0, "a"), (1, 1.0, 9.0, "b"), (2, 50.0, 50.0, "c")], "cell_id long, lon double, lat double, name string")
    pixels = spark.createDataFrame([(0, 0, 10.0), (1, 0, 10.0), (0, 1, 10.0), (1, 1, None)], "i long, j long, v double")
    got = {r["name"]: r["v"] for r in P.bilinear(points, pixels, "v", 1.0, 0.0, 10.0).collect()}
    assert got == {"a": 10.0, "b": 10.0, "c": None}


def test_index_joins_are_one_to_one(spark):
    panel, index = series(spark, [1, 2]), series(spark, [0.1, 0.2], name="spi_1")
    table = spark.createDataFrame([(1, 1, 9.0)], "cell_id long, month int, mm_per_unit double")
    assert column(X.join_index(panel, index, table), "mm_per_unit", "date") == [9.0, None]
    with pytest.raises(ValueError):
        X.join_index(panel, index.unionAll(index), table)


def test_p_values_against_the_driver(spark):
    from steppe.operators import evaluation as E

    rows = spark.createDataFrame([(float(t), n) for t in (0.0, 0.7, -2.5, 6.0) for n in range(2, 14)], "t double, n int")
    for r in rows.select("t", "n", E.student_p(F.col("t"), F.col("n") - 1).alias("p")).collect():
        assert r["p"] == pytest.approx(S.t_test(spark, r["t"], r["n"]), abs=1e-9)
    pairs = spark.createDataFrame([(w, k) for w in range(8) for k in range(8)], "w long, k long")
    for r in pairs.select("w", "k", E.sign_p(F.col("w"), F.col("k")).alias("p")).collect():
        want = S.sign_test(r["w"], r["k"])
        assert r["p"] == (None if want is None else pytest.approx(want))
    rng = random.Random(4)
    for n in (1, 5, 12, 30):
        d = [rng.gauss(0.3, 1) for _ in range(n)]
        order = sorted(d, key=abs)
        plus = float(sum(k for k, x in enumerate(order, 1) if x > 0))
        got = spark.createDataFrame([(plus, n)], "w double, n long").select(E.signed_rank_p(F.col("w"), F.col("n")).alias("p")).first()["p"]
        assert got == pytest.approx(S.wilcoxon(d))


def test_target_table_rejects_other_actuals(spark):
    from steppe.operators import evaluation as E

    target = Target("x", 1)
    panel = spark.createDataFrame([(c, date(2001 + m // 12, m % 12 + 1, 1), float((c * 7 + m * 5) % 11)) for c in range(12) for m in range(48)], "cell_id long, date date, x double")
    base = B.build(panel, target, Period.years(2001, 2003))
    test = Period.years(2004, 2004)
    issued = panel.select("cell_id", F.col("date").alias("issue_date"), F.lit(1).alias("lead_months"), F.lit("x").alias("target"), F.lead("x", 1).over(W.by_cell()).alias("actual"), F.col("x").alias("prediction"), F.lit("test").alias("split")).filter("actual is not null")
    cells = panel.select("cell_id").distinct()
    rows = {r["method"]: r for r in E.target_table(issued, base, cells, target, test).collect()}
    assert set(rows) == {"model", *E.BASELINES} and rows["ensemble_raw"]["n_dates"] == 0
    assert rows["persistence"]["model_skill_mae"] == 0 and rows["persistence"]["identical"] and rows["persistence"]["p_t"] is None
    assert rows["climatology"]["n_dates"] == 12 and rows["climatology"]["p_wilcoxon"] is not None or rows["climatology"]["p_t"] is not None
    with pytest.raises(ValueError):
        E.target_table(issued.withColumn("actual", F.col("actual") + 1), base, cells, target, test)


# zeros


def island(spark, ring, days=1):
    rows = []
    for d in range(days):
        for i in range(5):
            for j in range(5):
                inside = 0 < i < 4 and 0 < j < 4
                rows.append((i * 5 + j, date(2001, 1 + d, 1), i, j, 0.0 if inside else ring.get((i, j), 3.1) if d == 0 else 0.1))
    return spark.createDataFrame(rows, "cell_id long, date date, i long, j long, v double")


def test_zero_islands(spark):
    assert tuple(Z.clusters(island(spark, {}), "v").select("size", "boundary_min", "artefact").first()) == (9, 3.1, True)
    assert Z.clusters(island(spark, {(0, 2): 0.4}), "v").first()["artefact"] is False
    alone = spark.createDataFrame([(1, date(2001, 1, 1), 0, 0, 0.0), (2, date(2001, 1, 1), 1, 1, 0.0), (3, date(2001, 1, 1), 9, 9, 0.0)], "cell_id long, date date, i long, j long, v double")
    assert sorted((r["size"], r["artefact"]) for r in Z.clusters(alone, "v").collect()) == [(1, False), (2, False)]
    flagged = Z.flag_isolated(island(spark, {}, days=2), "v")
    assert {r["date"].month: r["n"] for r in flagged.groupBy("date").agg(F.count_if("zero_isolated").alias("n")).collect()} == {1: 9, 2: 0}
    assert Z.isolated_share(flagged).first()["n_isolated"] == 9
    assert Z.diagnostics(island(spark, {}), "v").first()["least_boundary"] == 3.1


# model


def test_model_beats_a_constant_and_shuffling_destroys_it(spark):
    rng = random.Random(1)
    rows = []
    for cell in range(12):
        x = 0.0
        for m in range(60):
            x = 0.9 * x + rng.gauss(0, 1)
            rows.append((cell, date(2001 + m // 12, m % 12 + 1, 1), x))
    frame = spark.createDataFrame(rows, "cell_id long, date date, x double")
    splits = {"train": Period.years(2001, 2003), "validation": Period(date(2004, 1, 1), date(2004, 9, 1)), "test": Period(date(2005, 1, 1), date(2005, 11, 1))}
    table = L.training_table(frame, ["x"], Target("x", 1), splits).cache()

    def skill(t):
        out = L.predict(L.fit_trees(t, Target("x", 1), trees=8, depth=3), t, Target("x", 1)).filter("split = 'test'")
        mean = t.filter("split = 'train'").agg(F.avg("actual")).first()[0]
        r = out.agg(F.avg(F.pow(F.col("actual") - F.col("prediction"), F.lit(2.0))).alias("m"), F.avg(F.pow(F.col("actual") - mean, F.lit(2.0))).alias("c")).first()
        return 1 - r["m"] / r["c"]

    assert skill(table) > 0.3 and skill(L.permuted(table)) < 0.25
    model = L.fit_trees(table, Target("x", 1), trees=30, depth=3, patience=3)
    assert 1 <= model.getNumTrees <= 30
    assert L.importances(model, table).first()["feature"] == "x_lag0"
    real, shuffled = L.linear_skill(table, "x_lag0").first(), L.linear_skill(L.permuted(table), "x_lag0").first()
    assert real["skill"] > 0.3 and shuffled["skill"] < 0.05
    assert L.permuted(table).agg(F.sum("actual")).first()[0] == pytest.approx(table.agg(F.sum("actual")).first()[0])


def test_rounds_end_after_patience():
    assert L.best_round([5.0, 4.0, 3.0, 3.0, 3.5, 2.0], 2) == 3
    assert L.best_round([5.0, 4.0, 3.0, 3.5, 2.0], 3) == 5
    assert L.best_round([1.0], 20) == 1


def test_cross_validation_leaves_each_fold_out(spark):
    rng = random.Random(3)
    rows = [(k % 3, float(x := rng.gauss(0, 1)), 2 * x + rng.gauss(0, 1)) for k in range(90)]
    got = {r["fold"]: r for r in L.cross_validated_line(spark.createDataFrame(rows, "fold int, x double, actual double"), "fold", "x").collect()}
    for fold in range(3):
        train, test = [r for r in rows if r[0] != fold], [r for r in rows if r[0] == fold]
        slope, intercept = statistics.linear_regression([r[1] for r in train], [r[2] for r in train])
        assert got[fold]["mse"] == pytest.approx(statistics.fmean((r[2] - intercept - slope * r[1]) ** 2 for r in test))


def test_targets_without_a_column_are_skipped():
    have, skip = L.available_targets([Target("spi_1", 1), Target("sm_anom", 1)], ["cell_id", "spi_1"])
    assert [t.name for t in have] == ["spi_1"] and [t.name for t in skip] == ["sm_anom"]


def test_classes_and_folds(spark):
    rows = series(spark, [float(i % 3) for i in range(40)])
    target = Target("x", 1, "classification", 1.0)
    table = L.training_table(rows, ["x"], target, {"train": YEARS, "validation": Period.years(2004, 2004)})
    assert {r["actual"] for r in table.collect()} == {0.0, 1.0}
    out = L.predict(L.fit_trees(table, target, trees=3, depth=2), table, target)
    assert out.filter("prediction < 0 OR prediction > 1").count() == 0
    cells = spark.range(16).select((F.col("id") % 4).alias("i"), F.floor(F.col("id") / 4).alias("j"))
    folds = cells.withColumn("f", L.spatial_fold(F.col("i"), F.col("j"), 2, 3)).groupBy(F.floor(F.col("i") / 2), F.floor(F.col("j") / 2)).agg(F.count_distinct("f").alias("n"))
    assert {r["n"] for r in folds.collect()} == {1}


# sources, reports, streams


def test_csv_and_yearly_loads(spark, tmp_path):
    (tmp_path / "a_2001.csv").write_text("cell_id,date,month,precip_mm,n_pentads,n_obs\n1,2001-01-01,1,NaN,6,6\n")
    (tmp_path / "a_2002.csv").write_text("cell_id,date,month,precip_mm,n_pentads,n_obs\n1,2002-01-01,1,2.5,6,6\n")
    rows = R.read_csv(spark, str(tmp_path / "a_*.csv"), R.PRECIPITATION)
    assert column(rows, "precip_mm") == [None, 2.5] and rows.filter("source_file LIKE '%a_2001.csv'").count() == 1
    path = str(tmp_path / "table")

    def read(year):
        return series(spark, [year], (year, 1))

    assert R.load_years(spark, read, path, [2001, 2002], ["cell_id", "date", "x"]) == [2001, 2002]
    assert R.load_years(spark, read, path, [2001, 2002, 2003], ["cell_id", "date", "x"]) == [2003]
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        R.load_years(spark, read, path, [2004], ["other"])


def test_verified_reads_and_retries(spark):
    with pytest.raises(R.TruncatedReadError):
        R.verified(spark.range(3), 4, "rows")
    pages = R.fetch_pages(spark, lambda at, n: [(k,) for k in range(at, min(at + n, 7))], 7, 7, "x", "k long", 3)
    assert sorted(r["k"] for r in pages.collect()) == list(range(7))
    with pytest.raises(R.TruncatedReadError):
        R.fetch_pages(spark, lambda at, n: [], 7, 7, "x", "k long")
    with pytest.raises(R.TruncatedReadError):
        R.fetch_pages(spark, lambda at, n: [], 7, 8, "x", "k long")
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("connection reset by peer")
        return "done"

    assert R.with_retry(flaky, "x", sleep=waits.append) == "done" and 1 <= waits[0] <= 1.5 and 2 <= waits[1] <= 2.5
    limited, missing = OSError("x"), OSError("not found")
    limited.code, missing.code = 503, 404
    assert R.is_transient(limited) and R.is_transient(TimeoutError()) and R.is_transient(RuntimeError("Quota exceeded")) and R.is_transient(ConnectionResetError())
    assert not R.is_transient(missing) and not R.is_transient(ValueError("row 1500")) and not R.is_transient(KeyError("500"))
    with pytest.raises(KeyError):
        R.with_retry(lambda: {}["no"], "x", sleep=waits.append)


def test_probes_fingerprints_and_provenance(spark, tmp_path):
    assert R.resolve_source(["/no/such", str(tmp_path)], lambda p: spark.read.text(p) if p == str(tmp_path) else spark.read.parquet(p)) == (str(tmp_path), "ok")
    assert R.resolve_source(["/no/such"], spark.read.parquet, core=False) == (None, "warn")
    assert R.coverage_shortfall(date(2025, 8, 1), date(2025, 12, 1)) and not R.coverage_shortfall(date(2025, 9, 1), date(2025, 12, 1))
    assert R.coverage(series(spark, [1, 2, 3]), "date", date(2001, 2, 1), date(2001, 9, 1)).first()["n_in_window"] == 2
    assert len(R.schema_fingerprint(["a", "b"])) == 16 != R.schema_fingerprint(["b", "a"])
    (tmp_path / "p.py").write_text("x")
    assert R.provenance([str(tmp_path / "p.py")])["producer_digest"] == R.provenance([str(tmp_path / "p.py")])["producer_digest"]


def test_markdown():
    text = reports.markdown_table([{"m": "a", "skill": 0.1, "n": None}], ["m", "skill", "n"], skill=("skill",), notes=["note"])
    assert "| a | +0.100 | n/a |" in text and "[1] note" in text
    assert reports.significance({"identical": True}) == "identical series"


def test_streams_sum_windows_and_close_sessions(spark, tmp_path):
    schema = "user_id long, ts timestamp, value double"
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 05:00:00", 2.0), (2, "2024-01-01 09:00:00", 4.0), (1, "2024-01-09 00:00:00", 8.0)]
    frame = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream.run_available(stream.windowed_sums(source, "user_id", "ts", "value"), str(tmp_path / "c1"), str(tmp_path / "o1"))
    got = {(r["user_id"], r["total"], r["n_obs"]) for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    assert got == {(1, 3.0, 2), (2, 4.0, 1)}
    stream.run_available(stream.sessions(source, "user_id", "ts", "6 hours"), str(tmp_path / "c2"), str(tmp_path / "o2"))
    assert {(r["user_id"], r["n_obs"]) for r in spark.read.parquet(str(tmp_path / "o2")).collect()} == {(1, 2), (2, 1)}


def test_gamma_batches_are_exact_at_large_shapes(spark):
    """Against sums of 1,359 and more terms with 60 digits: upper tails, and an index at the edge of its last digit."""
    shape, scale, amount = 5393.374206550967, 0.09600668897979735, 543.8
    cases = [(shape, 5664.188670379327, 0.000140547077118734631), (23749.164289, 25357.701907, 0.0), (None, 1.0, None), (2.0, None, None), (0.0, 1.0, None), (2.0, -1.0, 1.0)]
    frame = spark.createDataFrame([(a, x) for a, x, _ in cases], "a double, x double")
    for r, (_, _, above) in zip(frame.select(D.gamma_p_batch(F.col("a"), F.col("x")).alias("p")).collect(), cases, strict=True):
        if above is None:
            assert r["p"] is None
        else:
            assert 1 - r["p"] == pytest.approx(above, abs=1e-13 if above else 1e-9)
    amounts = spark.createDataFrame([(1, date(1999, 6, 1), amount)], "cell_id long, date date, amount double")
    params = spark.createDataFrame([(1, 6, 0.0, shape, scale)], "cell_id long, month int, q double, shape double, scale double")
    assert round(X.spi(amounts, params, "z").first()["z"], 6) == 3.632128


def test_sensitivity_has_no_term_by_term_lambdas(spark):
    rows = [(i, 1, 0.05 * (i % 3), 10 ** (i / 40 - 1), 2.0) for i in range(200)]
    params = spark.createDataFrame(rows, "cell_id long, month int, q double, shape double, scale double")
    out = X.sensitivity(params)
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString().lower()
    found = {r["cell_id"]: r["mm_per_unit"] for r in out.collect()}
    steps = [(i, q, a, D.gamma_ppf(F.lit((0.5 - q) / (1 - q)), F.lit(a), F.lit(2.0))) for i, _, q, a, _ in rows[:3]]
    for i, q, a, high in steps:
        low = D.gamma_ppf(F.lit((X.PHI_MINUS_ONE - q) / (1 - q)), F.lit(a), F.lit(2.0))
        assert spark.range(1).select(high - low).first()[0] == pytest.approx(found[i], rel=1e-12)
    back = params.join(out, "cell_id").withColumn("p", (0.5 - F.col("q")) / (1 - F.col("q"))).withColumn("x", D.gamma_ppf(F.col("p"), F.col("shape"), F.lit(1.0)))
    for r in back.select("p", D.gamma_p(F.col("shape"), F.col("x")).alias("b")).collect():
        assert r["b"] == pytest.approx(r["p"], abs=1e-10)
