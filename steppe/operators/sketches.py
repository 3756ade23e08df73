"""Mergeable sketches: distinct counts and quantiles of any period from stored monthly states.

The panel is read once. Each month of each group leaves a HyperLogLog state of
its distinct keys and a KLL state of its values, some kilobytes each; any period
and any coarser grouping is a union of states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steppe.config import Period

#: lg of the number of HLL registers, and k of KLL.
LG, K = 12, 400
#: Three standard errors of a distinct count (1.04 / sqrt(2^LG) each), and of a quantile's rank (Datasketches' published bound for K, at 99 %).
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG / 2), 0.0075


def monthly(panel: DataFrame, groups: list[str], distinct: str, value: str, lg: int = LG, k: int = K) -> DataFrame:
    """groups, date (month), n, keys (HLL) and amounts (KLL): the stored state."""
    rows = panel.groupBy(*groups, F.trunc("date", "month").alias("date"))
    return rows.agg(
        F.count(value).alias("n"),
        F.hll_sketch_agg(F.col(distinct), F.lit(lg)).alias("keys"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("amounts"),
    )


def merged(state: DataFrame, groups: list[str], period: Period | None = None, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """groups, n, n_distinct and quantiles (``q10`` ...) over a period, from stored states alone."""
    if period is not None:
        state = state.filter((F.col("date") >= F.lit(period.start)) & (F.col("date") <= F.lit(period.end)))
    rows = state.groupBy(*groups).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("amounts").alias("amounts"))
    found = [F.kll_sketch_get_quantile_double("amounts", F.lit(q)).alias(f"q{round(q * 100)}") for q in quantiles]
    return rows.select(*groups, "n", F.hll_sketch_estimate("keys").alias("n_distinct"), *found)
