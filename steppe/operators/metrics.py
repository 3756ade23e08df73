"""Scores of forecasts: for each date first, then the mean over dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steppe.operators.windows import correlation

MIN_ROWS = 10


def regression_by_date(rows: DataFrame, actual: str, forecast: str, keys: list[str] = ("date",), min_rows: int = MIN_ROWS) -> DataFrame:
    """MAE, RMSE and R2 (1 - SSE/SST, null for constant actuals) of each date."""
    error = F.col(actual) - F.col(forecast)
    sst = F.var_pop(actual) * F.count("*")
    good = rows.na.drop(subset=[actual, forecast])
    out = good.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(F.min(actual) < F.max(actual), 1 - F.sum(error * error) / sst).alias("r2"),
    )
    return out.filter(F.col("n") >= min_rows)


def brier_by_date(rows: DataFrame, actual: str, forecast: str, keys: list[str] = ("date",), min_rows: int = MIN_ROWS) -> DataFrame:
    error = F.col(forecast) - F.col(actual)
    out = rows.na.drop(subset=[actual, forecast]).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(error * error).alias("brier"))
    return out.filter(F.col("n") >= min_rows)


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with the mean of tied places."""
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(ties) - 1) / 2


def auc_by_date(rows: DataFrame, actual: str, forecast: str, keys: list[str] = ("date",), min_rows: int = MIN_ROWS) -> DataFrame:
    """Area under the ROC curve by rank sums; null for a date with one class."""
    keys = list(keys)
    good = rows.na.drop(subset=[actual, forecast]).withColumn("_rank", average_rank(forecast, keys))
    positive = F.sum(actual)
    negative = F.count("*") - positive
    rank_sum = F.sum(F.when(F.col(actual) == 1, F.col("_rank")).otherwise(0.0))
    auc = F.when((positive > 0) & (negative > 0), (rank_sum - positive * (positive + 1) / 2) / (positive * negative))
    out = good.groupBy(*keys).agg(F.count("*").alias("n"), auc.alias("auc"))
    return out.filter(F.col("n") >= min_rows)


def summarise(by_date: DataFrame, metrics: list[str], keys: list[str] = ()) -> DataFrame:
    """Mean over dates of each metric; nulls are skipped and counted."""
    means = [F.avg(m).alias(m) for m in metrics]
    undefined = [F.count_if(F.col(m).isNull()).alias(f"{m}_undefined") for m in metrics]
    return by_date.groupBy(*keys).agg(F.count("*").alias("n_dates"), *means, *undefined)


def undefined_dates(by_date: DataFrame, metric: str) -> DataFrame:
    return by_date.agg(F.array_sort(F.collect_list(F.when(F.col(metric).isNull(), F.col("date")))).alias("dates"))


def skill_score(model: Column, baseline: Column) -> Column:
    """1 - model / baseline: positive where the model is better; null on 0 or null."""
    return 1 - F.try_divide(model, baseline)


def issue_to_verification(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("verification_date", F.add_months("issue_date", F.col("lead_months")))


def on_forecast_dates(baselines: DataFrame, predictions: DataFrame) -> DataFrame:
    """Baselines on exactly the dates that the model forecasts."""
    dates = predictions.select(F.col("verification_date").alias("date")).distinct()
    return baselines.join(dates, "date", "left_semi")


def alignment_mismatches(predictions: DataFrame, baselines: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Dates on which the mean actual differs between the two tables."""
    a = predictions.groupBy(F.col("verification_date").alias("date")).agg(F.avg("actual").alias("a"))
    b = baselines.groupBy("date").agg(F.avg("actual").alias("b"))
    return a.join(b, "date").filter(F.abs(F.col("a") - F.col("b")) > tolerance)


def reliability(rows: DataFrame, actual: str, forecast: str, bins: int = 10) -> DataFrame:
    """Mean forecast, observed rate and number in equal bins of the forecast."""
    index = F.least(F.lit(bins - 1), F.floor(F.col(forecast) * bins).cast("int")).alias("bin")
    good = rows.na.drop(subset=[actual, forecast])
    return good.groupBy(index).agg(F.avg(forecast).alias("mean_forecast"), F.avg(actual).alias("observed"), F.count("*").alias("n"))


def sensitivity_bin(mm_per_unit: Column, edges: tuple[float, ...] = (5.0, 10.0, 20.0)) -> Column:
    label = F.lit(f">={edges[-1]:g}")
    low = 0.0
    for high in reversed(edges):
        low = max([e for e in edges if e < high], default=0.0)
        label = F.when(mm_per_unit < high, f"{low:g}-{high:g}").otherwise(label)
    return F.when(mm_per_unit.isNotNull(), label)


def paired(model: DataFrame, baseline: DataFrame, metric: str) -> DataFrame:
    """The two series on their common dates, finite values only."""
    a = model.select("date", F.col(metric).alias("m"))
    b = baseline.select("date", F.col(metric).alias("b"))
    joined = a.join(b, "date")
    return joined.filter(F.col("m").isNotNull() & F.col("b").isNotNull() & ~F.isnan("m") & ~F.isnan("b")).withColumn("d", F.col("b") - F.col("m"))


def paired_statistics(pairs: DataFrame, min_dates: int = 5) -> DataFrame:
    """n, mean difference, t, signed ranks, wins, losses and lag-1 correlation.

    One row. Differences are baseline minus model, so positive favours the model.
    """
    order = Window.orderBy("date")  # one row for each date
    size = F.abs("d")
    nonzero = F.col("d") != 0
    ties = Window.partitionBy(nonzero, size)
    rank = F.rank().over(Window.partitionBy(nonzero).orderBy(size)) + (F.count("*").over(ties) - 1) / 2
    rows = pairs.withColumn("_rank", F.when(nonzero, rank)).withColumn("_before", F.lag("d").over(order))
    n, std = F.count("*"), F.stddev_samp("d")
    r = F.when(n > 3, correlation("d", "_before"))
    stats = rows.agg(
        n.alias("n_dates"),
        F.avg("d").alias("mean_difference"),
        F.when(std > 0, F.avg("d") / (std / F.sqrt(n))).alias("t"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("_rank"))), F.lit(0.0)).alias("w_plus"),
        F.count_if(F.col("d") > 0).alias("wins"),
        F.count_if(F.col("d") < 0).alias("losses"),
        r.alias("lag1_r"),
        (F.coalesce(F.max(size), F.lit(0.0)) < 1e-12).alias("identical"),
    )
    usable = (F.col("n_dates") >= min_dates) & ~F.col("identical")
    return stats.withColumn("t", F.when(usable, F.col("t"))).withColumn("w_plus", F.when(usable, F.col("w_plus")))
