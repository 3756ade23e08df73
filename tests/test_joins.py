"""Spatial and temporal joins, reference periods, sketches and the paged source against plain versions."""

from __future__ import annotations

import math
import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from steppe.config import Period, Target
from steppe.operators import model as L
from steppe.operators import reference as V
from steppe.operators import sketches as K
from steppe.operators import spatial as G
from steppe.operators import temporal as T
from steppe.sources.paged import PagedSource

POLYGONS = "polygon_id long, rings array<array<array<double>>>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def inside(lon, lat, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("step", [0.07, 0.5, 40.0])
def test_polygons_with_holes_and_several_rings(spark, step):
    rng = random.Random(1)

    def blob(x, y, r, n):
        return [[x + r * rng.uniform(0.5, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.5, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]

    shapes = [(p, [blob(rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(0.3, 2), rng.randint(3, 12)) for _ in range(rng.randint(1, 3))]) for p in range(12)]
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]  # closed, with a hole and flat sides
    shapes += [(50, [square, [[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 1.5]]]), (51, [[[0.0, 0.0], [1.0, 1.0]]]), (52, [])]
    points = [(k, rng.uniform(-5, 5), rng.uniform(-5, 5)) for k in range(1500)] + [(5000 + k, (k % 9) / 4, (k // 9) / 4) for k in range(81)]
    frame = spark.createDataFrame([*points, points[0], (9000, None, 1.0), (9001, 1.0, None)], "cell_id long, lon double, lat double")
    found = G.points_in_polygons(frame, spark.createDataFrame(shapes, POLYGONS), step)
    want = sorted((k, p) for k, x, y in [*points, points[0]] for p, rings in shapes if inside(x, y, [r for r in rings if len(r) > 2]))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 300
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def km_between(x1, y1, x2, y2):
    a, b, c, d = map(math.radians, (x1, y1, x2, y2))
    return 2 * 6371.0 * math.asin(math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2))


@pytest.mark.parametrize("km", [3.0, 250.0, 4000.0])
def test_pairs_within_a_distance(spark, km):
    rng = random.Random(2)
    near = lambda x, y: (x + rng.gauss(0, km / 150), max(-90.0, min(90.0, y + rng.gauss(0, km / 150))))
    spots = [(30.0, 37.5), (179.99, 10.0), (-180.0, -60.0), (12.0, 89.9), (0.0, -90.0), (-179.5, 80.0)]
    points = [(k, *near(*spots[k % 6])) for k in range(60)]
    cells = [(1000 + k, *near(*spots[k % 6])) for k in range(300)]
    schema = "{} long, lon double, lat double"
    left = spark.createDataFrame([*points, (99, None, 0.0)], schema.format("point_id"))
    right = spark.createDataFrame([*cells, (1999, 0.0, None)], schema.format("cell_id"))
    found = G.within_km(left, right, km)
    want = {(p, c): km_between(x, y, u, v) for p, x, y in points for c, u, v in cells if km_between(x, y, u, v) <= km}
    got = {(r["point_id"], r["cell_id"]): r["km"] for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == found.count() > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_buffer_means(spark):
    cells = spark.createDataFrame([(1, 30.0, 37.0, 5.0), (2, 30.0, 37.01, 7.0), (3, 30.0, 37.01, None)], "cell_id long, lon double, lat double, v double")
    points = spark.createDataFrame([(1, 30.0, 37.0), (2, 50.0, 37.0)], "point_id long, lon double, lat double")
    assert sorted(map(tuple, G.buffer_mean(points, cells, "v", 2.0).collect())) == [(1, 2, 6.0), (2, 0, None)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 9])
def test_asof_with_a_hot_key(spark, strict, tolerance):
    rng = random.Random(3)
    day = lambda n: date(2001, 1, 1) + timedelta(n)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c"])
    left = [(n, key(), day(rng.randint(0, 300))) for n in range(200)] + [(900, None, day(3)), (901, "hot", None), (902, "none", day(5)), (0, "hot", day(7))]
    right = [(key(), day(rng.randint(0, 300)), float(rng.randint(0, 9))) for _ in range(60)] + [(None, day(1), 1.0), ("hot", None, 2.0)]
    found = T.asof_join(
        spark.createDataFrame(left, "n long, k string, day date"), spark.createDataFrame(right, "k string, day date, v double"), ["k"], "day", ["v"], span=14, tolerance=tolerance, strict=strict
    )
    want = []
    for n, k, d in left:
        fits = [(t, v) for q, t, v in right if None not in (q, t, k, d) and q == k and (t < d or t == d and not strict)]
        best = max(fits, default=(None, None))
        want.append((n, k, d, *(best if tolerance is None or best[0] is None or (d - best[0]).days <= tolerance else (None, None))))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_overlapping_intervals(spark, span):
    rng = random.Random(4)
    make = lambda n: [(k, rng.choice("aaab"), a := rng.randint(-50, 50), a + rng.choice([-1, 0, 1, 3, 40])) for k in range(n)]
    left, right = make(80), make(60)
    found = T.overlapping(
        spark.createDataFrame([*left, (500, "a", None, 5)], "x long, k string, start long, end long"), spark.createDataFrame(right, "y long, k string, from long, until long"), ["k"], span
    )
    want = sorted((x, y) for x, k, a, b in left for y, q, c, d in right if k == q and a < b and c < d and a < d and c < b)
    assert sorted((r["x"], r["y"]) for r in found.collect()) == want and len(want) > 50
    with pytest.raises(ValueError):
        T.overlapping(spark.range(1).selectExpr("id k", "id start", "id end", "id z"), spark.range(1).selectExpr("id k", "id from", "id until", "id z"), ["k"], 5)


def test_every_column_has_one_reference_period(spark):
    panel = spark.createDataFrame([(1, date(2000 + y, 1, 1), float(y), float(y * y)) for y in range(10)], "cell_id long, date date, a double, b double")
    early, late = Period.years(2000, 2003), Period.years(2004, 2009)
    rows = V.standardized(panel, {"early": (early, ["a"]), "late": (late, ["b"])}, {"a": [1], "b": []}).orderBy("date").collect()
    mean, sd = 1.5, math.sqrt(5 / 3)
    assert [r["a_anom"] for r in rows] == pytest.approx([(y - mean) / sd for y in range(10)])
    assert rows[0]["a_anom_lag1"] is None and rows[5]["a_anom_lag1"] == pytest.approx(rows[4]["a_anom"])
    squares = [y * y for y in range(4, 10)]
    m = sum(squares) / 6
    assert rows[0]["b_anom"] == pytest.approx(-m / math.sqrt(sum((x - m) ** 2 for x in squares) / 5)) and "b_anom_lag1" not in rows[0]
    with pytest.raises(ValueError, match="a: no reference period"):
        V.statistics(panel, {"late": (late, ["b"])}, ["a", "b"])
    with pytest.raises(ValueError, match="b: reference periods early, late"):
        V.statistics(panel, {"early": (early, ["a", "b"]), "late": (late, ["b"])}, ["a", "b"])
    assert V.period_table(spark, {"early": (early, ["a", "b"]), "late": (late, ["b"])}).count() == 3
    assert V.standardized(panel, {"early": (Period.years(2000, 2001), ["a"])}, {"a": []}).filter("a_anom IS NOT NULL").isEmpty()


def test_static_features(spark):
    panel = spark.createDataFrame([(c, date(2001, m, 1), float(m)) for c in (1, 2) for m in range(1, 13)], "cell_id long, date date, x double")
    fixed = spark.createDataFrame([(1, 0.5), (2, None)], "cell_id long, slope double")
    table = L.training_table(panel, ["x"], Target("x", 1), {"train": Period.years(2001, 2001)}, lags=(0,), static=fixed)
    assert L.feature_names(table) == ["x_lag0", "month_sin", "month_cos", "static_slope"] and {r["cell_id"] for r in table.collect()} == {1}
    with pytest.raises(ValueError):
        L.training_table(panel, ["x"], Target("x", 1), {"train": Period.years(2001, 2001)}, static=fixed.unionByName(fixed))


def test_sketches_merge_without_the_panel(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("id % 3 AS g", "date_add(DATE '2001-01-01', CAST(id % 700 AS INT)) AS date", "id % 9000 AS k", "pmod(id * 7919, 10007) AS v")
    K.monthly(rows, ["g"], "k", "v").write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    period = Period.years(2001, 2001)
    found = K.merged(state, ["g"], period)
    assert "range" not in plan_of(found).lower().split("scan parquet")[0] and str(tmp_path) in plan_of(found)
    values = {g: sorted(r["v"] for r in rows.filter(f"g = {g} AND year(date) = 2001").collect()) for g in range(3)}
    keys = {r["g"]: r["n"] for r in rows.filter("year(date) = 2001").groupBy("g").agg(F.count_distinct("k").alias("n")).collect()}
    for r in found.collect():
        own = values[r["g"]]
        assert r["n"] == len(own) and abs(r["n_distinct"] - keys[r["g"]]) <= K.DISTINCT_ERROR * keys[r["g"]]
        for q, name in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90")):
            at = sum(v <= r[name] for v in own) / len(own)
            assert abs(at - q) <= K.RANK_ERROR + 1 / len(own)
    assert K.merged(state, []).first()["n"] == 40_000


def test_paged_source_fetches_each_page_once(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    monkeypatch.setenv("STEPPE_PAGES_LOG", str(log))
    os.environ["PYTHONPATH"] = f"{os.path.dirname(__file__)}:{os.environ['PYTHONPATH']}"
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "paged_pages.py"))
    spark.sparkContext.environment["STEPPE_PAGES_LOG"] = str(log)
    spark.dataSource.register(PagedSource)

    def source(fetch, **more):
        read = spark.read.format("steppe_paged").option("fetch", f"paged_pages:{fetch}").option("total", 45).option("page", 10).option("base", 0.01)
        return read.options(**more).schema("k long, name string").load()

    rows = source("numbers")
    assert rows.rdd.getNumPartitions() == 5
    assert sorted(tuple(r) for r in rows.collect()) == [(k, f"row {k}") for k in range(45)]
    assert sorted(map(int, log.read_text().split())) == [0, 10, 20, 30, 40]  # every page once
    source("numbers").write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 45
    with pytest.raises(Exception, match="9 rows, expected 10"):
        source("truncated").collect()
    with pytest.raises(Exception, match="the caller 46"):
        source("numbers", expected=46).collect()
    with pytest.raises(Exception, match="declared schema"):
        spark.read.format("steppe_paged").option("fetch", "paged_pages:numbers").option("total", 1).load()
