"""Drought indices: gamma fit, SPI, its sensitivity, SPEI, evapotranspiration.

The fit is one aggregation by cell and calendar month over the fit years; index
and sensitivity read the same table of parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steppe.config import Period
from steppe.functions.distributions import digamma, gamma_p_batch, gamma_ppf, let, log_gamma, norm_ppf, trigamma
from steppe.operators.panel import KEYS, require_unique
from steppe.operators.windows import rolling_sum

#: Normal distribution at -1 and 0.
PHI_MINUS_ONE, PHI_ZERO = 0.15865525393145707, 0.5


def accumulate(panel: DataFrame, value: str, months: int) -> DataFrame:
    """cell_id, date, amount: the sum over the last ``months`` months."""
    amount = F.col(value) if months == 1 else rolling_sum(value, months)
    return panel.select("cell_id", "date", amount.alias("amount"))


def gamma_fit(amounts: DataFrame, fit: Period, min_samples: int = 5, estimator: str = "thom") -> DataFrame:
    """q, shape and scale by cell and calendar month.

    ``q`` is the share of zeros. Both estimators need only the mean and the
    mean logarithm of the positive amounts: ``thom`` in closed form, ``mle`` by
    Newton steps from there. Null where there are fewer than ``min_samples``
    values, or positive ones, or where all are equal.
    """
    rows = amounts.filter((F.col("date") >= F.lit(fit.start)) & (F.col("date") <= F.lit(fit.end)) & F.col("amount").isNotNull())
    positive = F.when(F.col("amount") > 0, F.col("amount"))
    stats = rows.groupBy("cell_id", F.month("date").alias("month")).agg(
        F.count("amount").alias("n"),
        F.count(positive).alias("n_positive"),
        (F.count_if(F.col("amount") == 0) / F.count("amount")).alias("share_zero"),
        F.avg(positive).alias("mean"),
        F.avg(F.log(positive)).alias("mean_log"),
    )
    spread = F.log("mean") - F.col("mean_log")
    enough = (F.col("n") >= min_samples) & (F.col("n_positive") >= min_samples) & (spread > 1e-12)
    stats = stats.withColumn("s", F.when(enough, spread))
    thom = (1 + F.sqrt(1 + 4 * F.col("s") / 3)) / (4 * F.col("s"))
    if estimator == "thom":
        shape = thom
    elif estimator == "mle":
        def step(a, _):
            return a - (F.log(a) - digamma(a) - F.col("s")) / (1 / a - trigamma(a))

        shape = F.when(F.col("s").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(8)), thom, step))
    else:
        raise ValueError(f"no estimator {estimator}")
    fitted = stats.withColumn("shape", shape).withColumn("scale", F.col("mean") / F.col("shape"))
    return fitted.select("cell_id", "month", "n", "n_positive", F.when(F.col("shape").isNotNull(), F.col("share_zero")).alias("q"), "shape", "scale")


def spi(amounts: DataFrame, params: DataFrame, name: str, limit: float = 4.0) -> DataFrame:
    """The index of each amount; null without a fit, clipped at ``limit``."""
    rows = amounts.withColumn("month", F.month("date")).join(params, ["cell_id", "month"], "left")
    h = F.col("q") + (1 - F.col("q")) * gamma_p_batch(F.col("shape"), F.col("amount") / F.col("scale"))
    edge = 1e-9
    inside = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), F.col("_h")))
    clipped = F.greatest(F.lit(-limit), F.least(F.lit(limit), norm_ppf(inside)))  # these skip nulls
    rows = rows.withColumn("_h", h)
    return rows.select("cell_id", "date", F.when(F.col("_h").isNotNull(), clipped).alias(name))


def sensitivity(params: DataFrame) -> DataFrame:
    """Amount between index -1 and 0 of each fit, from the same parameters."""

    def value_at(p: float) -> Column:
        q = F.col("q")
        return F.when(q >= p, 0.0).otherwise(gamma_ppf((p - q) / (1 - q), F.col("shape"), F.col("scale")))

    step = value_at(PHI_ZERO) - value_at(PHI_MINUS_ONE)
    return params.select("cell_id", "month", F.when(F.col("shape").isNotNull(), step).alias("mm_per_unit"))


def with_sensitivity(index: DataFrame, table: DataFrame) -> DataFrame:
    rows = index.withColumn("month", F.month("date")).join(table, ["cell_id", "month"], "left")
    return rows.drop("month")


def join_index(panel: DataFrame, index: DataFrame, table: DataFrame, check: bool = True) -> DataFrame:
    """The panel with its index and the sensitivity of each cell and month, one to one.

    With ``check``, repeated keys on any side are an error instead of more rows.
    """
    if check:
        require_unique(panel, KEYS, "panel")
        require_unique(index, KEYS, "index")
        require_unique(table, ["cell_id", "month"], "sensitivity")
    return panel.join(with_sensitivity(index, table), KEYS, "left")


def evaporation_ratio(precipitation: Column, potential: Column) -> Column:
    """Actual over potential evapotranspiration; null where the latter is zero."""
    return F.try_divide(precipitation, potential)


def unreliable(mm_per_unit: Column, least: float = 5.0) -> Column:
    return mm_per_unit < least


def spei(panel: DataFrame, precipitation: str, evapotranspiration: str, months: int, fit: Period, min_samples: int = 5) -> DataFrame:
    """Log-logistic index of the climatic balance, by unbiased L-moments."""
    balance = panel.withColumn("_balance", F.col(precipitation) - F.col(evapotranspiration))
    rows = accumulate(balance, "_balance", months).withColumn("month", F.month("date"))
    own = Window.partitionBy("cell_id", "month")
    sample = rows.filter((F.col("date") >= F.lit(fit.start)) & (F.col("date") <= F.lit(fit.end)) & F.col("amount").isNotNull())
    ranked = sample.withColumn("k", F.row_number().over(own.orderBy("amount", "date"))).withColumn("n", F.count("*").over(own))
    ranked = ranked.filter(F.col("n") >= max(3, min_samples))  # fewer have no third moment
    x, k, n = F.col("amount"), F.col("k"), F.col("n")
    fits = ranked.groupBy("cell_id", "month").agg(
        F.max("n").alias("n"),
        F.avg(x).alias("w0"),
        F.avg(x * (n - k) / (n - 1)).alias("w1"),
        F.avg(x * (n - k) * (n - k - 1) / ((n - 1) * (n - 2))).alias("w2"),
    )
    beta = F.try_divide(2 * F.col("w1") - F.col("w0"), 6 * F.col("w1") - F.col("w0") - 6 * F.col("w2"))
    fits = fits.withColumn("beta", beta).filter("beta > 1 AND beta < 1000")  # beyond, the three parameters cancel each other out
    g = F.exp(log_gamma(1 + 1 / F.col("beta")) + log_gamma(1 - 1 / F.col("beta")))
    fits = fits.withColumn("alpha", (F.col("w0") - 2 * F.col("w1")) * F.col("beta") / g)
    fits = fits.withColumn("gamma", F.col("w0") - F.col("alpha") * g)
    joined = rows.join(fits, ["cell_id", "month"], "left")
    above = F.col("amount") - F.col("gamma")
    h = F.when(above > 0, 1 / (1 + F.pow(F.try_divide(F.col("alpha"), above), F.col("beta")))).when(above <= 0, 0.0)
    inside = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), h))
    good = (F.col("alpha") > 0) & h.isNotNull() & ~F.isnan(h)
    return joined.select("cell_id", "date", F.when(good, norm_ppf(inside)).alias(f"spei_{months}"))


def reference_evapotranspiration(tmax: Column, tmin: Column, dew: Column, wind2: Column, radiation: Column, pressure: Column) -> Column:
    """Penman-Monteith for a grass surface, mm a day: struct(mm, clamped).

    Temperatures in degrees, wind in m/s at two metres, net radiation in MJ/m2
    a day, pressure in kPa. Negative results become zero and are flagged.
    """

    def saturated(t: Column) -> Column:
        return 0.6108 * F.exp(17.27 * t / (t + 237.3))

    mean = (tmax + tmin) / 2
    slope = 4098 * saturated(mean) / F.pow(mean + 237.3, F.lit(2.0))
    psychrometric = 0.000665 * pressure
    deficit = (saturated(tmax) + saturated(tmin)) / 2 - saturated(dew)
    top = 0.408 * slope * radiation + psychrometric * 900 / (mean + 273) * wind2 * deficit
    raw = top / (slope + psychrometric * (1 + 0.34 * wind2))
    return let(raw, lambda x: F.struct(F.greatest(x, F.lit(0.0)).alias("mm"), (x < 0).alias("clamped")))


def expected_below(threshold: float) -> float:
    """Normal probability below a threshold."""
    return 0.5 * math.erfc(-threshold / math.sqrt(2))
