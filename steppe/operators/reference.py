"""Reference periods: every column is standardised by one period of its own.

Records of different length can't share a reference period. Which column
belongs to which period is a small table; a column in no period, or in two, is an
error and not a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steppe.config import Period
from steppe.operators.windows import by_cell


def period_table(spark: SparkSession, periods: dict[str, tuple[Period, list[str]]]) -> DataFrame:
    """column, period, start and end: a row for each assignment, repeated ones too."""
    rows = [(c, name, p.start, p.end) for name, (p, columns) in periods.items() for c in columns]
    return spark.createDataFrame(rows, "column string, period string, start date, end date")


def assigned(periods: dict[str, tuple[Period, list[str]]], columns: list[str]) -> dict[str, Period]:
    """The period of each column; an error unless each has exactly one."""
    found = {c: [(name, p) for name, (p, members) in periods.items() for m in members if m == c] for c in columns}
    wrong = {c: [name for name, _ in ps] for c, ps in found.items() if len(ps) != 1}
    if wrong:
        raise ValueError("; ".join(f"{c}: {'no reference period' if not names else 'reference periods ' + ', '.join(names)}" for c, names in sorted(wrong.items())))
    return {c: ps[0][1] for c, ps in found.items()}


def _inside(column: str, period: Period) -> Column:
    return F.when((F.col("date") >= F.lit(period.start)) & (F.col("date") <= F.lit(period.end)), F.col(column))


def statistics(panel: DataFrame, periods: dict[str, tuple[Period, list[str]]], columns: list[str]) -> DataFrame:
    """cell_id, month and, for each column, its number, mean and deviation over its own period: one aggregation."""
    own = assigned(periods, columns)
    sums = [f(_inside(c, own[c])).alias(f"{c}_ref_{n}") for c in columns for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))]
    return panel.groupBy("cell_id", F.month("date").alias("month")).agg(*sums)


def standardized(panel: DataFrame, periods: dict[str, tuple[Period, list[str]]], lags: dict[str, list[int]], least: int = 3) -> DataFrame:
    """cell_id, date and ``<column>_anom`` with the lags each column asks for, for all columns in one pass.

    An anomaly is (value - mean) / deviation of its calendar month in its own
    period; null where the period has fewer than ``least`` values or no spread.
    The panel is dense, so a row lag is a calendar lag.
    """
    columns = list(lags)
    stats = statistics(panel, periods, columns)
    rows = panel.select("cell_id", "date", F.month("date").alias("month"), *columns).join(stats, ["cell_id", "month"])

    def anomaly(c: str) -> Column:
        usable = (F.col(f"{c}_ref_n") >= least) & (F.col(f"{c}_ref_sd") > 0)
        return F.when(usable, (F.col(c) - F.col(f"{c}_ref_mean")) / F.col(f"{c}_ref_sd")).alias(f"{c}_anom")

    rows = rows.select("cell_id", "date", *[anomaly(c) for c in columns])
    lagged = [F.lag(f"{c}_anom", k).over(by_cell()).alias(f"{c}_anom_lag{k}") for c in columns for k in lags[c]]
    return rows.select("*", *lagged)
