"""Ordered operators on cells: one window specification for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from steppe.functions.calendar import month_cos, month_sin

LAGS = (0, 1, 2, 3, 6)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of the pairs; null when either side is constant."""
    one, two = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    spread = F.stddev_pop(one) * F.stddev_pop(two)
    return F.try_divide(F.covar_pop(a, b), spread)


def by_cell() -> WindowSpec:
    return Window.partitionBy("cell_id").orderBy("date")


def rolling_sum(value: str, months: int) -> Column:
    """Sum of this month and those before it; null until all are there."""
    frame = by_cell().rowsBetween(-(months - 1), 0)
    return F.when(F.count(value).over(frame) == months, F.sum(value).over(frame))


def centred_mean(value: str, months: int = 12) -> Column:
    """Mean of an even window that reaches half its length back; null unless full."""
    half = months // 2
    frame = by_cell().rowsBetween(-half, months - half - 1)
    return F.when(F.count(value).over(frame) == months, F.avg(value).over(frame))


def lag_features(panel: DataFrame, columns: list[str], lags=LAGS) -> DataFrame:
    """Lagged columns and the cyclic month, in one select and so one sort."""
    lagged = [F.lag(c, k).over(by_cell()).alias(f"{c}_lag{k}") for c in columns for k in lags]
    cyclic = [month_sin(F.col("date")).alias("month_sin"), month_cos(F.col("date")).alias("month_cos")]
    return panel.select("cell_id", "date", *lagged, *cyclic)


def lead_value(value: str, months: int) -> Column:
    return F.lead(value, months).over(by_cell())


def below(value: Column, threshold: float) -> Column:
    """Comparison that keeps nulls."""
    return value < threshold


def calendar_shift(panel: DataFrame, value: str, months: int, name: str) -> DataFrame:
    """The value ``months`` earlier by calendar, as an equi-join; also right with gaps."""
    past = panel.select("cell_id", F.add_months("date", months).alias("date"), F.col(value).alias(name))
    return panel.join(past, ["cell_id", "date"], "left")


def distinct_steps(rows: DataFrame, value: str) -> DataFrame:
    """Differences between neighbouring distinct values."""
    order = Window.orderBy(value)
    return rows.select(value).distinct().withColumn("step", F.col(value) - F.lag(value).over(order)).filter("step is not null")


def middle_row(rows: DataFrame, strata: list[str], order: list[str]) -> DataFrame:
    """The row at position n // 2 (from 0) of each stratum."""
    w = Window.partitionBy(*strata)
    ranked = rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.col("_k") == F.floor(F.col("_n") / 2) + 1).drop("_k", "_n")


def autocorrelation(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Lag-1 correlation over dates; null below four dates or for a constant series."""
    shifted = series.withColumn("_before", F.lag(value).over(Window.partitionBy(*keys).orderBy("date")))
    r = F.when(F.count(value) > 3, correlation(value, "_before"))
    return shifted.groupBy(*keys).agg(F.count(value).alias("n_dates"), r.alias("lag1_r"))


def anomaly(panel: DataFrame, value: str, reference: Column) -> DataFrame:
    """Standardised anomaly by cell and calendar month over the reference rows."""
    w = Window.partitionBy("cell_id", F.month("date"))
    inside = F.when(reference, F.col(value))
    mean, std = F.avg(inside).over(w), F.stddev_samp(inside).over(w)
    return panel.withColumn(f"{value}_anom", F.when(std > 0, (F.col(value) - mean) / std))
