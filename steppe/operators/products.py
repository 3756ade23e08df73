"""Forecast products: ensembles, their bias, availability, effective sample size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steppe.functions import geo

#: Source pixels across the region below which a source is shown as the region's mean only.
MIN_PIXELS = 3.0


@dataclass(frozen=True)
class Layer:
    """A column as it is shown: an observation or a forecast, and the pixel size of its source in degrees."""

    column: str
    kind: str
    source_degrees: float

    def is_map(self, region_degrees: float) -> bool:
        return region_degrees / self.source_degrees >= MIN_PIXELS


def availability(panel: DataFrame, columns: list[str]) -> DataFrame:
    """A flag ``<name>_available`` for each column: whether the row has a value."""
    return panel.withColumns({f"{c}_available": F.col(c).isNotNull() for c in columns})


def ensemble(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, spread, terciles and number of the members of each key, exact."""
    return members.groupBy(*keys).agg(
        F.count(value).alias("n_members"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("spread"),
        F.percentile(value, F.lit(1 / 3)).alias("lower_tercile"),
        F.percentile(value, F.lit(2 / 3)).alias("upper_tercile"),
    )


def bias_table(forecasts: DataFrame, observed: DataFrame, keys: list[str], value: str, groups: list[Column]) -> DataFrame:
    """Mean forecast minus observation in each group, over rows that have both."""
    both = forecasts.select(*keys, F.col(value).alias("_f")).join(observed.select(*keys, F.col(value).alias("_o")), keys)
    both = both.filter(F.col("_f").isNotNull() & F.col("_o").isNotNull())
    return both.groupBy(*groups).agg(F.avg(F.col("_f") - F.col("_o")).alias("bias"), F.count("*").alias("n"))


def unbiased(forecasts: DataFrame, bias: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Forecasts less the bias of their group; a group without a bias stays as it is."""
    rows = forecasts.join(bias.select(*groups, "bias"), groups, "left")
    return rows.withColumn(value, F.col(value) - F.coalesce("bias", F.lit(0.0))).drop("bias")


def cross_calibration(one: DataFrame, two: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Slope and intercept that bring the second product to the first."""
    both = one.select(*keys, F.col(value).alias("_y")).join(two.select(*keys, F.col(value).alias("_x")), keys)
    return both.agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_count("_y", "_x").alias("n"))


def effective_cells(rows: DataFrame, native: str) -> DataFrame:
    """For each date the cells, and the coarse pixels that they share: the independent samples."""
    return rows.groupBy("date").agg(F.count_distinct("cell_id").alias("n_cells"), F.count_distinct(native).alias("n_effective"))


def reference_columns(panel: DataFrame, periods: dict[str, str]) -> DataFrame:
    """column and reference period of each column of the panel that has one."""
    rows = [(c, p) for c, p in periods.items() if c in panel.columns]
    return panel.sparkSession.createDataFrame(rows, "column string, period string")


def product_views(panel: DataFrame, layers: list[Layer], cell_degrees: float, region_degrees: float) -> DataFrame:
    """layer, kind, cell_id, date, value, n_cells, resolution_degrees, source_degrees: what may be shown of each column.

    A source with fewer than ``MIN_PIXELS`` pixels across the region has no map: its
    rows are means of the region, without a cell_id, whose resolution is the region.
    The others have a row for each cell with a value. Both come from one scan of the
    panel. A kind other than observation and forecast, and a layer named twice, are errors.
    """
    if bad := [x.column for x in layers if x.kind not in ("observation", "forecast") or x.source_degrees <= 0]:
        raise ValueError(f"not an observation or forecast with a pixel size: {bad}")
    if len({x.column for x in layers}) < len(layers):
        raise ValueError("a layer is named twice")
    shown = F.array(*[
        F.struct(
            F.lit(x.column).alias("layer"), F.lit(x.kind).alias("kind"), F.col(x.column).cast("double").alias("value"),
            F.lit(float(x.source_degrees)).alias("source_degrees"),
            F.when(F.lit(x.is_map(region_degrees)), F.col("cell_id").cast("long")).alias("cell_id"),
            F.lit(float(cell_degrees if x.is_map(region_degrees) else region_degrees)).alias("resolution_degrees"),
        )
        for x in layers
    ])
    rows = panel.select("date", F.explode(shown).alias("x")).select("date", "x.*").filter("value IS NOT NULL")
    keys = ["layer", "kind", "cell_id", "date", "resolution_degrees", "source_degrees"]
    return rows.groupBy(*keys).agg(F.avg("value").alias("value"), F.count("*").alias("n_cells"))


def skill_map(forecasts: DataFrame, base: str, min_dates: int = 5) -> DataFrame:
    """cell_id, method, n_dates, rmse, base_rmse, skill and has_skill of each method other than ``base`` in each cell.

    ``forecasts``: cell_id, date, method, actual, forecast. Only dates on which a
    cell has both the method and the base count. Cells with fewer than ``min_dates``
    of them, or whose base is never wrong, have no skill value; ``has_skill`` is false there.
    """
    rows = forecasts.na.drop(subset=["actual", "forecast"]).withColumn("error", F.pow(F.col("actual") - F.col("forecast"), F.lit(2.0)))
    own = rows.filter(F.col("method") != base).select("cell_id", "date", "method", "error")
    both = own.join(rows.filter(F.col("method") == base).select("cell_id", "date", F.col("error").alias("base_error")), ["cell_id", "date"])
    found = both.groupBy("cell_id", "method").agg(F.count("*").alias("n_dates"), F.sqrt(F.avg("error")).alias("rmse"), F.sqrt(F.avg("base_error")).alias("base_rmse"))
    found = found.withColumn("skill", F.when(F.col("n_dates") >= min_dates, 1 - F.try_divide("rmse", "base_rmse")))
    return found.withColumn("has_skill", F.coalesce(F.col("skill") > 0, F.lit(False)))


def skill_features(cells: DataFrame, skill: DataFrame, cell_degrees: float, source_degrees: float) -> DataFrame:
    """cell_id, method and a GeoJSON feature of each cell's skill, labelled with both resolutions.

    Cells without a row of skill have one feature with a null method, so that the map has no holes.
    """
    rows = cells.select("cell_id", "lon", "lat").join(skill, "cell_id", "left").withColumns(
        {
            "has_skill": F.coalesce("has_skill", F.lit(False)),
            "layer": F.lit("skill"),
            "resolution_degrees": F.lit(float(cell_degrees)),
            "source_degrees": F.lit(float(source_degrees)),
        }
    )
    shown = ["cell_id", "method", "n_dates", "rmse", "base_rmse", "skill", "has_skill", "layer", "resolution_degrees", "source_degrees"]
    return geo.features(rows, cell_degrees / 2, shown, ("cell_id", "method"))
