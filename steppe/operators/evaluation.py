"""The table of a target: scores of the model and of every baseline, side by side.

Predictions are keyed by issue date, baselines by verification date. The table
moves predictions to verification dates, takes baselines on exactly those
dates, proves that both sides have the same actuals there, scores each date,
and compares the model with each baseline: skill, R2 difference, paired tests.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steppe.config import Period, Target
from steppe.functions.distributions import let, log_gamma, norm_cdf
from steppe.operators import metrics as M
from steppe.operators.panel import within
from steppe.operators.windows import correlation
from steppe.storage import materialize

#: Paired differences up to which the signed ranks have their exact distribution.
EXACT_RANKS = 50
BASELINES = ("climatology", "persistence", "known_accumulation", "ensemble_raw")


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, by its finite series in the angle; null for null or df < 1."""

    def series(x):
        cosine, odd = F.cos(x["angle"]), x["df"] % 2 == 1
        first = F.when(odd, cosine).otherwise(F.lit(1.0))
        low = F.when(odd, 2.0).otherwise(1.0)
        n = F.floor((x["df"] - F.when(odd, 3).otherwise(2)) / 2).cast("int")
        steps = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        start = F.struct(first.alias("term"), first.alias("total"))

        def step(acc, k):
            term = acc["term"] * cosine * cosine * (low + 2 * (k - 1)) / (low + 2 * (k - 1) + 1)
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        total = F.aggregate(steps, start, step, lambda acc: acc["total"]) * F.sin(x["angle"])
        total = F.when(x["df"] == 1, 0.0).otherwise(total)
        return 1 - F.when(odd, (x["angle"] + total) * 2 / math.pi).otherwise(total)

    df = df.cast("double")
    value = F.struct(F.atan(F.abs(t) / F.sqrt(df)).alias("angle"), df.alias("df"))
    return F.when(t.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), let(value, series)))


def sign_p(wins: Column, losses: Column) -> Column:
    """Two-sided binomial p of the sign test; ties are left out, null without any difference."""
    n, low = (wins + losses).cast("double"), F.least(wins, losses).cast("int")

    def term(k):
        return F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) - n * math.log(2))

    tail = F.aggregate(F.sequence(F.lit(0), low), F.lit(0.0), lambda acc, k: acc + term(k.cast("double")))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def exact_signed_rank(doubled: Column, plus: Column) -> Column:
    """Two-sided exact p of Wilcoxon's signed ranks, ties included.

    ``doubled``: twice the ranks, which are whole numbers also where ties share
    a mean rank; ``plus``: twice the sum of the positive ones. The number of
    sign patterns with each sum grows by one rank a step.
    """

    def ways(acc, r):
        return F.transform(acc, lambda x, s: x + F.when(s >= r, F.get(acc, s - r)).otherwise(0.0))

    def exact(x):
        total = F.aggregate(x["ranks"], F.lit(0), lambda a, r: a + r)
        start = F.transform(F.sequence(F.lit(0), total), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
        counts = F.aggregate(x["ranks"], start, ways)
        low = F.least(x["plus"], total - x["plus"])
        tail = F.aggregate(F.slice(counts, F.lit(1), low + 1), F.lit(0.0), lambda a, b: a + b)
        return F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), F.size(x["ranks"])))

    return let(F.struct(doubled.alias("ranks"), plus.cast("int").alias("plus")), exact)


def normal_signed_rank(w_plus: Column, n: Column, ties: Column) -> Column:
    """Two-sided normal p, with the variance that ties leave; ``ties`` is the sum of t^3 - t over groups of t equal sizes."""
    n = n.cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return F.when(spread > 0, 2 * norm_cdf(-F.abs(w_plus - n * (n + 1) / 4) / spread))


def signed_rank_p(w_plus: Column, n: Column, most: int = EXACT_RANKS) -> Column:
    """The exact p for up to ``most`` untied differences; else null."""
    ranks = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: 2 * k)
    return F.when((w_plus == F.floor(w_plus)) & (n > 0) & (n <= most), exact_signed_rank(ranks, 2 * w_plus))


def signed_ranks(pairs: DataFrame, keys: list[str], difference: str = "d", most: int = EXACT_RANKS, digits: int = 12) -> DataFrame:
    """keys, n_ranked, w_plus, tied and p_wilcoxon of paired differences.

    Zero differences are left out, equal sizes share their mean rank. Up to
    ``most`` differences have the exact p, with ties or without; more have the
    normal one with the variance that ties leave. Null without any difference.
    """
    rows = pairs.filter(F.col(difference) != 0).select(*keys, F.round(F.abs(difference), digits).alias("size"), (F.col(difference) > 0).alias("plus"))
    ties = F.count("*").over(Window.partitionBy(*keys, "size"))
    rows = rows.withColumn("ties", ties).withColumn("doubled", (2 * F.rank().over(Window.partitionBy(*keys).orderBy("size")) + F.col("ties") - 1).cast("int"))
    plus = F.coalesce(F.sum(F.when(F.col("plus"), F.col("doubled"))), F.lit(0))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n_ranked"),
        plus.alias("plus"),
        F.bool_or(F.col("ties") > 1).alias("tied"),
        F.sum(F.col("ties") * F.col("ties") - 1).alias("correction"),
        F.collect_list("doubled").alias("doubled"),
    )
    exact = exact_signed_rank(F.array_sort("doubled"), F.col("plus"))
    normal = normal_signed_rank(F.col("plus") / 2, F.col("n_ranked"), F.col("correction"))
    p = F.when(F.col("n_ranked") <= most, exact).otherwise(normal)
    return found.select(*keys, "n_ranked", (F.col("plus") / 2).alias("w_plus"), "tied", p.alias("p_wilcoxon"))


def by_method(predictions: DataFrame, baselines: DataFrame, population: DataFrame, target: Target, period: Period) -> DataFrame:
    """cell_id, date, method, actual and forecast on the verification dates of the test predictions."""
    mine = F.col("target") == target.name
    model = M.issue_to_verification(within(predictions.filter(mine & (F.col("split") == "test")), population))
    model = model.filter((F.col("verification_date") >= F.lit(period.start)) & (F.col("verification_date") <= F.lit(period.end)))
    base = M.on_forecast_dates(within(baselines.filter(mine), population), model)
    suffix = "_prob" if target.kind == "classification" else ""
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}{suffix}").alias("forecast")) for m in BASELINES])
    rows = base.select("cell_id", "date", F.col("actual_prob" if suffix else "actual").alias("actual"), F.explode(methods).alias("m"))
    rows = rows.select("cell_id", "date", "m.method", "actual", "m.forecast")
    own = model.select("cell_id", F.col("verification_date").alias("date"), F.lit("model").alias("method"), "actual", F.col("prediction").alias("forecast"))
    return own.unionByName(rows)


def misaligned_dates(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Dates on which the model's mean actual is not that of the baselines, or that one side lacks."""
    mean = rows.groupBy("date").agg(
        F.avg(F.when(F.col("method") == "model", F.col("actual"))).alias("a"), F.avg(F.when(F.col("method") == "climatology", F.col("actual"))).alias("b")
    )
    return mean.filter(~F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))


def scores_by_date(rows: DataFrame, target: Target, min_rows: int = M.MIN_ROWS) -> DataFrame:
    """method, date and the metrics of the target's kind."""
    keys = ["method", "date"]
    if target.kind != "classification":
        return M.regression_by_date(rows, "actual", "forecast", keys, min_rows)
    brier = M.brier_by_date(rows, "actual", "forecast", keys, min_rows)
    return brier.join(M.auc_by_date(rows, "actual", "forecast", keys, min_rows).drop("n"), keys, "left")


def comparisons(by_date: DataFrame, metric: str, min_dates: int = 5) -> DataFrame:
    """One row for each baseline: the paired difference to the model and its tests, positive where the model is better."""
    model = by_date.filter("method = 'model'").select("date", F.col(metric).alias("m"))
    pairs = by_date.filter("method <> 'model'").select("method", "date", F.col(metric).alias("b")).join(model, "date")
    pairs = pairs.filter(F.col("m").isNotNull() & F.col("b").isNotNull()).select("method", "date", (F.col("b") - F.col("m")).alias("d"))
    n, spread = F.count("*"), F.stddev_samp("d")
    pairs = pairs.withColumn("before", F.lag("d").over(Window.partitionBy("method").orderBy("date")))
    found = pairs.groupBy("method").agg(
        n.alias("n_pairs"),
        F.avg("d").alias("mean_difference"),
        F.when(spread > 0, F.avg("d") / (spread / F.sqrt(n))).alias("t"),
        F.count_if(F.col("d") > 0).alias("wins"),
        F.count_if(F.col("d") < 0).alias("losses"),
        (F.max(F.abs("d")) < 1e-12).alias("identical"),
        F.when((n > 3) & (spread > 0), correlation("d", "before")).alias("lag1_r"),
    )
    usable = (F.col("n_pairs") >= min_dates) & ~F.col("identical")
    return found.join(signed_ranks(pairs, ["method"]), "method", "left").select(
        "method", "n_pairs", "mean_difference", "wins", "losses", "identical",
        F.when(usable, F.col("t")).alias("t"),
        F.when(usable, student_p(F.col("t"), F.col("n_pairs") - 1)).alias("p_t"),
        F.when(usable, sign_p(F.col("wins"), F.col("losses"))).alias("p_sign"),
        F.when(usable, F.col("p_wilcoxon")).alias("p_wilcoxon"),
        F.when(usable, F.col("lag1_r")).alias("lag1_r"),
    )


def target_table(predictions: DataFrame, baselines: DataFrame, population: DataFrame, target: Target, period: Period, min_rows: int = M.MIN_ROWS, check: bool = True) -> DataFrame:
    """One row for the model and each baseline.

    On a baseline's row, ``model_skill_*`` and ``r2_difference`` are the model's
    against it, and so are the paired tests (on MAE, or Brier for classes). A
    baseline without forecasts keeps its row, with nulls. With ``check``, an
    actual on which the two sides disagree is an error.
    """
    rows = materialize(by_method(predictions, baselines, population, target, period), "target-rows")  # the check, scores and ranks read it
    if check and not misaligned_dates(rows).isEmpty():
        raise ValueError(f"{target.name}: predictions and baselines disagree about their actuals")
    metrics = ["brier", "auc"] if target.kind == "classification" else ["mae", "rmse", "r2"]
    by_date = materialize(scores_by_date(rows, target, min_rows), "target-scores")
    methods = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("model", *BASELINES)))).alias("method"))
    table = methods.join(M.summarise(by_date, metrics, ["method"]), "method", "left").withColumn("n_dates", F.coalesce("n_dates", F.lit(0)))
    everything = Window.partitionBy(F.lit(1))  # five rows
    other = F.col("method") != "model"

    def of_model(metric: str) -> Column:
        return F.max(F.when(~other, F.col(metric))).over(everything)

    skill = [F.when(other, M.skill_score(of_model(m), F.col(m))).alias(f"model_skill_{m}") for m in metrics if m not in ("r2", "auc")]
    difference = [F.when(other, of_model(m) - F.col(m)).alias(f"{m}_difference") for m in metrics if m in ("r2", "auc")]
    table = table.select(F.lit(target.name).alias("target"), F.lit(target.lead_months).alias("lead_months"), "*", *skill, *difference)
    return table.join(comparisons(by_date, metrics[0]), "method", "left")


def scores_by_group(rows: DataFrame, groups: list[str]) -> DataFrame:
    """MAE, RMSE and number for each method, and within it by each of the groups, by grouping sets.

    ``grouping`` names the group; the other columns are null.
    """
    good = rows.na.drop(subset=["actual", "forecast"])
    error = F.col("actual") - F.col("forecast")
    sets = [[F.col("method")], *[[F.col("method"), F.col(g)] for g in groups]]
    name = F.lit("all")
    for g in groups:
        name = F.when(F.grouping(g) == 0, g).otherwise(name)
    found = good.groupingSets(sets, "method", *groups).agg(name.alias("grouping"), F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    return found.select("grouping", "method", *groups, "n", "mae", "rmse")
