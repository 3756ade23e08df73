"""p-values of paired series: a few numbers, computed on the driver."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession


def t_test(spark: SparkSession, t: float | None, n: int) -> float | None:
    """Two-sided p of a paired t statistic."""
    if t is None or n < 2:
        return None
    student = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(n - 1))
    return 2 * student.cumulativeProbability(-abs(float(t)))


def sign_test(wins: int, losses: int) -> float | None:
    """Two-sided binomial p; ties are excluded."""
    n = wins + losses
    if not n:
        return None
    low = min(wins, losses)
    tail = sum(math.comb(n, k) for k in range(low + 1)) / 2**n
    return min(1.0, 2 * tail)


def wilcoxon(differences: list[float]) -> float | None:
    """Two-sided signed-rank p: exact for up to 50 untied differences, else normal."""
    d = [x for x in differences if x != 0]
    n = len(d)
    if not n:
        return None
    sizes = sorted(abs(x) for x in d)
    rank = {}
    for s in set(sizes):
        first = sizes.index(s) + 1
        rank[s] = first + (sizes.count(s) - 1) / 2
    plus = sum(rank[abs(x)] for x in d if x > 0)
    total = n * (n + 1) / 2
    w = min(plus, total - plus)
    if len(rank) == n and n == len(differences) and n <= 50:
        ways = [1] + [0] * int(total)
        for r in range(1, n + 1):
            for s in range(int(total), r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    ties = sum(sizes.count(s) ** 3 - sizes.count(s) for s in set(sizes))
    deviation = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(w - total / 2) / deviation / math.sqrt(2)) if deviation else None


def paired_test(spark: SparkSession, statistics, differences: list[float]) -> dict:
    """p-values for a row of ``paired_statistics`` and its differences by date."""
    row = statistics.first()
    usable = row["n_dates"] >= 5 and not row["identical"]
    return row.asDict() | {
        "p_t": t_test(spark, row["t"], row["n_dates"]) if usable else None,
        "p_wilcoxon": wilcoxon(differences) if usable else None,
        "p_sign": sign_test(row["wins"], row["losses"]) if usable else None,
    }
