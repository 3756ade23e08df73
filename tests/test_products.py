"""What may be shown of a source, where a forecast has skill, and what a source covers."""

from __future__ import annotations

import json
from datetime import date

import pytest

from steppe.operators import products as R
from steppe.sources import readers as N


def test_a_coarse_source_has_no_map(spark):
    rows = [(1, date(2001, 1, 1), 1.0, 4.0), (2, date(2001, 1, 1), None, 8.0), (1, date(2001, 2, 1), 3.0, None), (2, date(2001, 2, 1), 5.0, None)]
    panel = spark.createDataFrame(rows, "cell_id long, date date, rain double, mass double")
    layers = [R.Layer("rain", "forecast", 0.1), R.Layer("mass", "observation", 3.0)]
    got = sorted((r["layer"], r["cell_id"], r["date"].month, r["value"], r["n_cells"], r["resolution_degrees"]) for r in R.product_views(panel, layers, 0.05, 6.0).collect())
    assert got == [("mass", None, 1, 6.0, 2, 6.0), ("rain", 1, 1, 1.0, 1, 0.05), ("rain", 1, 2, 3.0, 1, 0.05), ("rain", 2, 2, 5.0, 1, 0.05)]
    assert R.product_views(panel.limit(0), layers, 0.05, 6.0).count() == 0
    for bad in ([R.Layer("rain", "guess", 0.1)], [R.Layer("rain", "forecast", 0.0)], layers[:1] * 2):
        with pytest.raises(ValueError):
            R.product_views(panel, bad, 0.05, 6.0)


def test_pixels_across_the_region_decide():
    assert R.Layer("x", "observation", 1.0).is_map(3.0) and not R.Layer("x", "observation", 1.0).is_map(2.9)


def test_skill_map_counts_shared_dates_and_has_no_holes(spark):
    def month(k):
        return date(2001, k + 1, 1)

    rows = [(1, month(k), m, 0.0, f) for k in range(6) for m, f in (("model", 1.0), ("base", 2.0))]
    rows += [(2, month(k), m, 0.0, f) for k in range(6) for m, f in (("model", 3.0), ("base", 2.0))]
    rows += [(3, month(k), m, 0.0, f) for k in range(4) for m, f in (("model", 1.0), ("base", 2.0))]
    rows += [(4, month(k), m, 0.0, f) for k in range(6) for m, f in (("model", 1.0), ("base", 0.0))]
    rows += [(1, month(6), "model", 0.0, 99.0), (1, month(7), "model", None, 9.0), (1, month(7), "base", 0.0, 9.0)]
    skill = R.skill_map(spark.createDataFrame(rows, "cell_id long, date date, method string, actual double, forecast double"), "base")
    got = {r["cell_id"]: (r["n_dates"], r["skill"], r["has_skill"]) for r in skill.collect()}
    assert got == {1: (6, 0.5, True), 2: (6, -0.5, False), 3: (4, None, False), 4: (6, None, False)}

    cells = spark.createDataFrame([(k, 30.0 + k, 38.0) for k in range(1, 6)], "cell_id long, lon double, lat double")
    made = {r["cell_id"]: json.loads(r["feature"]) for r in R.skill_features(cells, skill, 0.05, 0.1).collect()}
    assert sorted(made) == [1, 2, 3, 4, 5]
    assert [made[k]["properties"]["has_skill"] for k in range(1, 6)] == [True, False, False, False, False]
    assert {f["properties"]["source_degrees"] for f in made.values()} == {0.1} and "skill" not in made[5]["properties"]
    (ring,) = made[1]["geometry"]["coordinates"]
    assert ring[0] == ring[-1] and ring[0] == pytest.approx([30.975, 37.975])


def test_probes_name_what_is_missing(spark):
    tables = {
        "full": spark.createDataFrame([(date(2001, 1, 1), 1.0), (date(2001, 12, 1), 1.0)], "day date, x double"),
        "short": spark.createDataFrame([(date(2001, 2, 1), 1.0)], "day date, x double"),
        "other": spark.createDataFrame([(1.0,)], "x double"),
        "empty": spark.createDataFrame([], "day date, x double"),
    }
    sources = [
        N.Source("a", ("gone", "full"), "day", ("x",)),
        N.Source("b", ("short",), "day"),
        N.Source("c", ("full",), "day", ("y", "x"), core=False),
        N.Source("d", ("other",), "day"),
        N.Source("e", ("empty",), "day", core=False),
        N.Source("f", ("gone",), "day", core=False),
        N.Source("g", ("gone",), "day"),
    ]
    got = {r["source"]: r for r in N.probe_sources(sources, tables.__getitem__, date(2001, 1, 1), date(2001, 12, 1)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ok", "b": "warn", "c": "warn", "d": "fail", "e": "warn", "f": "warn", "g": "fail"}
    assert (got["a"]["resolved"], got["a"]["n_in_window"], got["a"]["short"]) == ("full", 2, False)
    assert got["b"]["short"] and got["c"]["missing"] == ["y"] and got["d"]["missing"] == ["day"] and got["e"]["short"] is None
