"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Each rule rejects a document when one of its ratios exceeds a cut-off. Cut-offs
come from a fixed grid and labelled holdouts, by a fixed sequence of tests: each
step tightens one rule to its next cut-off, all rules in turn, from the loosest
on. A step is certified when the exact binomial bound shows, at level ``delta``
divided by the number of strata, that all rules together, as tight as they are
by then, reject at most ``alpha`` of the good documents; the first step that is
not ends the stratum's sequence, so no further correction is due. What rejects
fewer documents than a certified step is covered by its bound. So each rule
takes, among its certified cut-offs, the one that rejects most bad documents
beyond the good ones it rejects, at a tie the loosest, and stays idle where none
rejects more bad than good. A stratum needs ``log(delta / strata) / log(1 - alpha)``
good labels (about 110) for any certificate.

Defined results: a null text counts as empty; labels without quality are
ignored, and of several for one document the best counts; null strata form a
stratum of their own; further columns are ignored; empty tables give no rows,
and without labels only the base rules reject.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steppe.functions.distributions import log_gamma
from steppe.llm.shared import let, materialize

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Cut-offs tried for each rule, tightest first.
GRID = {
    "symbols": (0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3),
    "dup_lines": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeats": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "capitals": (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
}
ALPHA, DELTA = 0.04, 0.05


def steps() -> list[tuple[int, str, float]]:
    """The fixed sequence: number from 1, rule and the cut-off it is tightened to."""
    levels = [(level, rule, float(c)) for rule, cuts in GRID.items() for level, c in enumerate(sorted(cuts, reverse=True))]
    return [(i, rule, c) for i, (_, rule, c) in enumerate(sorted(levels, key=lambda x: x[0]), 1)]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash; sorted hashes bring equal windows
    together, so a text of n words takes n log n steps.
    """

    def covered(order):
        twin = F.filter(
            order,
            lambda x, k: ((k > 0) & (order[F.greatest(k - 1, F.lit(0))]["h"] == x["h"]))
            | ((k < F.size(order) - 1) & (order[F.least(k + 1, F.size(order) - 1)]["h"] == x["h"])),
        )
        at = F.sort_array(F.transform(twin, lambda x: x["i"]))
        gaps = let(
            at,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - p[F.greatest(k - 1, F.lit(0))]))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )
        return gaps

    def count(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, count))


def signals(docs: DataFrame, stratum: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The counts that the rules use, for each document, computed row by row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stats = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    line_stats = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    stratum = F.col("lang") if stratum is None else stratum
    rows = docs.select(
        *[F.col(c) for c in (keep or ["doc_id"])],
        F.coalesce(stratum.cast("string"), F.lit("")).alias("_stratum"),
        stats.alias("_w"),
        line_stats.alias("_l"),
        (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("_symbols"),
        (F.size(F.split(text, r"\p{Lu}")) - 1).cast("long").alias("_capitals"),
    )
    failed = (F.col("_w.n_words") < 50) | (100 * F.col("_w.n_repeat_words") > 50 * F.col("_w.n_words"))
    return rows.select(*(keep or ["doc_id"]), "_stratum", "_w", "_l", "_symbols", "_capitals", failed.alias("_failed"))


def _ratio(rule: str) -> Column:
    over = {
        "symbols": (F.col("_symbols"), F.col("_w.word_chars")),
        "dup_lines": (F.col("_l.n_dup_lines"), F.col("_l.n_lines")),
        "repeats": (F.col("_w.n_repeat_words"), F.col("_w.n_words")),
        "capitals": (F.col("_capitals"), F.col("_w.word_chars")),
    }[rule]
    return over[0].cast("double") / F.greatest(over[1], F.lit(1)).cast("double")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """Exact P(X <= k) for X ~ Binomial(n, p).

    The largest term times the sum of the ratios to it. Below the mean the
    terms fall away like a Gaussian tail, so some square roots of n are summed
    and the rest is under 1e-20 of the result; above the mean the other tail
    is summed, and taken from one.
    """

    def tail(k, n, p):
        """P(X <= k) for k below the mean."""

        def step(acc, j):
            ratio = acc["ratio"] * (k - j + 1) * (1 - p) / ((n - k + j) * p)
            return F.struct(ratio.alias("ratio"), (acc["total"] + ratio).alias("total"))

        steps = F.least(k.cast("long"), (10 * F.sqrt(n * (1 - p) * p) + 100).cast("long"))
        start = F.struct(F.lit(1.0).alias("ratio"), F.lit(1.0).alias("total"))
        terms = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>"))
        total = F.aggregate(terms, start, step, lambda acc: acc["total"])
        ways = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)
        return F.exp(ways + k * math.log(p) + (n - k) * math.log1p(-p)) * total

    k, n = k.cast("double"), n.cast("double")
    below = F.least(F.lit(1.0), tail(k, n, p))
    above = F.greatest(F.lit(0.0), 1 - tail(n - k - 1, n, 1 - p))
    return F.when(k < 0, 0.0).when(k >= n, 1.0).when(k <= n * p, below).otherwise(above)


def calibrate(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cut-offs by stratum and rule: one row for each stratum with a certified and useful one.

    One aggregation counts the labelled documents by the first step that rejects
    them, by any rule and by each rule; running sums of these few rows are the
    numbers of the tests.
    """
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") == 1).alias("_good"))
    seen = stats.filter(~F.col("_failed")).select("doc_id", "_stratum", *[_ratio(r).alias(r) for r in GRID]).join(marks, "doc_id")
    plan = steps()
    firsts = [F.coalesce(*[F.when(F.col(r) > c, F.lit(i)) for i, rule, c in plan if rule == r]).alias(r) for r in GRID]
    seen = seen.select("_stratum", "_good", *firsts)
    kinds = {"all": F.lit(0), "any": F.least(*GRID)} | {r: F.col(r) for r in GRID}
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), step.alias("step")) for kind, step in kinds.items()])
    counts = seen.select("_stratum", "_good", F.inline(kinds)).filter("step IS NOT NULL").groupBy("_stratum", "kind", "step")
    counts = materialize(counts.agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")), "quality-counts")
    strata = counts.filter("kind = 'all'").select("_stratum", F.col("good").alias("n_good"))
    level = delta / max(1, strata.count())
    listed = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(r).alias("rule"), F.lit(c).alias("cutoff")) for i, r, c in plan])
    table = strata.select("*", F.inline(listed))
    table = table.join(counts.filter("kind = 'any'").select("_stratum", "step", F.col("good").alias("k")), ["_stratum", "step"], "left")
    own = counts.select("_stratum", F.col("kind").alias("rule"), "step", (F.col("bad") - F.col("good")).alias("gain"))
    table = table.join(own, ["_stratum", "rule", "step"], "left")
    so_far = Window.partitionBy("_stratum").orderBy("step")
    table = table.withColumn("k", F.coalesce(F.sum("k").over(so_far), F.lit(0)))
    table = table.withColumn("gain", F.sum("gain").over(Window.partitionBy("_stratum", "rule").orderBy("step")))
    table = table.withColumn("holds", F.bool_and(binomial_cdf(F.col("k"), F.col("n_good"), alpha) <= level).over(so_far))
    sure = table.filter(F.col("holds") & (F.col("gain") > 0))
    best = sure.groupBy("_stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("best"))
    pivoted = best.groupBy("_stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("best.cutoff"))).alias(f"_cut_{r}") for r in GRID])
    return materialize(pivoted, "quality-cutoffs")


def judge(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``_kept`` and ``_reasons``. The cut-offs are one small row per stratum."""
    fired = [F.when(F.coalesce(_ratio(r) > F.col(f"_cut_{r}"), F.lit(False)), F.lit(r)) for r in GRID]
    reasons = F.array_compact(F.array(F.when(F.col("_failed"), F.lit("base")), *fired))
    rows = stats.join(cutoffs, "_stratum", "left").withColumn("_reasons", reasons)
    return rows.withColumn("_kept", F.size("_reasons") == 0)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns and no shuffle of texts.

    Counts are computed once and written beside their rows; the cut-offs read
    the narrow counts, the verdict then all of it.
    """
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang")  # columns of any name
    stats = materialize(signals(rows, keep=["doc_id", "_row"]), "quality-signals")
    return judge(stats, calibrate(stats, labels)).filter("_kept").select("_row.*")
