"""Naive forecasts, all keyed by the date they verify on.

Fit years are arguments everywhere. A statistic of the fit period is one small
aggregate joined back; what is known at issue time is a lag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steppe.config import Period, Target
from steppe.operators.indices import accumulate, gamma_fit, spi
from steppe.operators.panel import within
from steppe.operators.windows import by_cell, rolling_sum


def _fit_rows(panel: DataFrame, fit: Period) -> DataFrame:
    return panel.filter((F.col("date") >= F.lit(fit.start)) & (F.col("date") <= F.lit(fit.end)))


def climatology_table(panel: DataFrame, target: str, fit: Period) -> DataFrame:
    """Mean by cell and calendar month over the fit period; nulls are skipped."""
    return _fit_rows(panel, fit).groupBy("cell_id", F.month("date").alias("month")).agg(F.avg(target).alias("climatology"))


def rate_table(panel: DataFrame, target: str, threshold: float, fit: Period, null_as_false: bool = False) -> DataFrame:
    """Share below the threshold by cell and calendar month.

    Nulls are skipped; with ``null_as_false`` they count as not below.
    """
    state = F.col(target) < threshold
    state = F.coalesce(state, F.lit(False)) if null_as_false else state
    return _fit_rows(panel, fit).groupBy("cell_id", F.month("date").alias("month")).agg(F.avg(state.cast("double")).alias("climatology_prob"))


def lookup(panel: DataFrame, table: DataFrame) -> DataFrame:
    """Joins a table by cell and calendar month; cells without a fit get null."""
    return panel.withColumn("month", F.month("date")).join(table, ["cell_id", "month"], "left").drop("month")


def climatology(panel: DataFrame, target: str, fit: Period) -> DataFrame:
    return lookup(panel.select("cell_id", "date"), climatology_table(panel, target, fit))


def climatology_probability(panel: DataFrame, target: str, threshold: float, fit: Period, null_as_false: bool = False) -> DataFrame:
    return lookup(panel.select("cell_id", "date"), rate_table(panel, target, threshold, fit, null_as_false))


def persistence(panel: DataFrame, target: str, lead: int) -> DataFrame:
    """The value at issue time: ``lead`` months before the verification date."""
    return panel.select("cell_id", "date", F.lag(target, lead).over(by_cell()).alias("persistence"))


def transition_table(panel: DataFrame, target: str, lead: int, threshold: float, fit: Period, population: DataFrame | None = None) -> DataFrame:
    """P(below, ``lead`` months later | state now): pooled pairs of the population.

    Both months of a pair lie in the fit period, so nothing after it is used.
    """
    rows = within(panel, population) if population is not None else panel
    later = F.lead(target, lead).over(by_cell())
    pairs = rows.select("date", (F.col(target) < threshold).alias("now"), (later < threshold).cast("double").alias("future"))
    inside = (F.col("date") >= F.lit(fit.start)) & (F.add_months("date", lead) <= F.lit(fit.end))
    return pairs.filter(inside).na.drop(subset=["now", "future"]).groupBy("now").agg(F.avg("future").alias("rate"), F.count("*").alias("n"))


def require_both_states(table: DataFrame) -> DataFrame:
    states = {r["now"] for r in table.select("now").collect()}
    if states != {True, False}:
        raise ValueError(f"the fit period has only the states {sorted(states)}; persistence can't be calibrated")
    return table


def persistence_probability(panel: DataFrame, target: str, lead: int, threshold: float, table: DataFrame) -> DataFrame:
    """The calibrated rate of the state at issue time; null stays null."""
    known = F.lag(target, lead).over(by_cell()) < threshold
    rows = panel.select("cell_id", "date", known.alias("now"))
    rates = table.select("now", F.col("rate").alias("persistence_prob"))  # two rows
    return rows.join(F.broadcast(rates), "now", "left").select("cell_id", "date", "persistence_prob")


def known_accumulation(panel: DataFrame, monthly: str, months: int, lead: int, fit: Period) -> DataFrame:
    """Forecast of a sum over ``months`` when its first months are already observed.

    What was observed at issue plus the climatology of the months to come; when
    the lead reaches past all of them, the climatology of the whole sum.
    """
    overlap = max(0, months - lead)
    rows = panel.withColumn("_sum", rolling_sum(monthly, months))
    if overlap == 0:
        return lookup(rows.select("cell_id", "date"), climatology_table(rows, "_sum", fit)).withColumnRenamed("climatology", "known_accumulation")
    expected = lookup(rows, climatology_table(rows, monthly, fit))
    to_come = by_cell().rowsBetween(-(lead - 1), 0) if lead else None
    observed_frame = by_cell().rowsBetween(-(months - 1), -lead)
    observed = F.when(F.count(monthly).over(observed_frame) == overlap, F.sum(monthly).over(observed_frame))
    rest = F.when(F.count("climatology").over(to_come) == lead, F.sum("climatology").over(to_come)) if lead else F.lit(0.0)
    return expected.select("cell_id", "date", (observed + rest).alias("known_accumulation"))


def possible_sums(panel: DataFrame, monthly: str, months: int, lead: int, fit: Period) -> DataFrame:
    """cell_id, date and amount: what is observed at issue plus the rest of each fit year.

    One row for each fit year whose months to come (the last ``lead`` of the
    window) all lie in the fit period, so as many rows as there are fit years.
    """
    overlap = max(0, months - lead)
    ahead = min(lead, months)
    frame = by_cell().rowsBetween(-(months - 1), -lead)
    observed = F.when(F.count(monthly).over(frame) == overlap, F.sum(monthly).over(frame)) if overlap else F.lit(0.0)
    rows = panel.select("cell_id", "date", F.month("date").alias("month"), observed.alias("observed"))
    if ahead == 0:
        return rows.select("cell_id", "date", F.col("observed").alias("amount"))
    inside = (F.col("date") <= F.lit(fit.end)) & (F.col("date") >= F.add_months(F.lit(fit.start), ahead - 1))
    rest = panel.select("cell_id", "date", rolling_sum(monthly, ahead).alias("rest")).filter(inside & F.col("rest").isNotNull())
    rest = rest.select("cell_id", F.month("date").alias("month"), "rest")
    return rows.join(rest, ["cell_id", "month"], "left").select("cell_id", "date", (F.col("observed") + F.col("rest")).alias("amount"))


def known_accumulation_probability(panel: DataFrame, monthly: str, months: int, lead: int, threshold: float, fit: Period, params: DataFrame | None = None) -> DataFrame:
    """Share of the fit years whose months to come would bring the sum below the threshold.

    With ``params``, gamma parameters of the sums, the threshold is one of the index.
    """
    sums = possible_sums(panel, monthly, months, lead, fit)
    if params is not None:
        sums = spi(sums, params, "amount")
    share = F.avg((F.col("amount") < threshold).cast("double"))
    return sums.groupBy("cell_id", "date").agg(share.alias("known_accumulation_prob"))


def empty_forecast(panel: DataFrame, name: str = "ensemble_raw") -> DataFrame:
    """A forecast that is not available: its rows are kept, its values null."""
    return panel.select("cell_id", "date", F.lit(None).cast("double").alias(name))


def build(panel: DataFrame, target: Target, fit: Period, population: DataFrame | None = None, monthly: str | None = None, min_samples: int = 5) -> DataFrame:
    """All baselines of one target, one row for each cell and verification date.

    Where the lead is shorter than the target's accumulation, ``monthly`` names
    the amounts that the index accumulates; its known accumulation is the index
    of what is observed plus the climatology of the rest.
    """
    name, lead = target.name, target.lead_months
    overlap = max(0, target.accumulation - lead)
    out = panel.select(
        "cell_id", "date", F.lit(name).alias("target"), F.lit(lead).alias("lead_months"), F.lit(target.kind).alias("kind"),
        F.col(name).alias("actual"), F.lag(name, lead).over(by_cell()).alias("persistence"),
    )
    out = lookup(out, climatology_table(panel, name, fit))
    params = None
    if overlap == 0:
        out = out.withColumn("known_accumulation", F.col("climatology"))
    elif monthly is None:
        raise ValueError(f"{name} at lead {lead} has {overlap} observed months: name its monthly amounts")
    else:
        params = gamma_fit(accumulate(panel, monthly, target.accumulation), fit, min_samples)
        sums = known_accumulation(panel, monthly, target.accumulation, lead, fit).withColumnRenamed("known_accumulation", "amount")
        out = out.join(spi(sums, params, "known_accumulation"), ["cell_id", "date"], "left")
    out = out.withColumn("ensemble_raw", F.lit(None).cast("double"))
    if target.kind == "classification":
        table = transition_table(panel, name, lead, target.threshold, fit, population).select("now", F.col("rate").alias("persistence_prob"))
        out = lookup(out, rate_table(panel, name, target.threshold, fit))
        out = out.withColumn("now", F.col("persistence") < target.threshold).join(F.broadcast(table), "now", "left").drop("now")
        out = out.withColumn("actual_prob", (F.col("actual") < target.threshold).cast("double"))
        if overlap == 0:
            out = out.withColumn("known_accumulation_prob", F.col("climatology_prob"))
        else:
            out = out.join(known_accumulation_probability(panel, monthly, target.accumulation, lead, target.threshold, fit, params), ["cell_id", "date"], "left")
        out = out.withColumn("ensemble_raw_prob", F.lit(None).cast("double"))
    return out
