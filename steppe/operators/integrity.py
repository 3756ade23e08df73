"""Expectations, digests and audits: a table is written only if all hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steppe.operators.windows import correlation


@dataclass(frozen=True)
class Expectation:
    check: str
    expected: object
    actual: object

    @property
    def ok(self) -> bool:
        return self.expected == self.actual


def report(expectations: list[Expectation]) -> bool:
    """Prints both numbers of each check; whether all agree."""
    for e in expectations:
        print(f"{'ok  ' if e.ok else 'FAIL'} {e.check}: expected {e.expected}, actual {e.actual}")
    return all(e.ok for e in expectations)


def gate(expectations: list[Expectation]) -> None:
    if not report(expectations):
        raise ValueError("; ".join(e.check for e in expectations if not e.ok))


def as_frame(spark: SparkSession, expectations: list[Expectation]) -> DataFrame:
    rows = [(e.check, str(e.expected), str(e.actual), e.ok) for e in expectations]
    return spark.createDataFrame(rows, "check string, expected string, actual string, ok boolean")


def digest(rows: DataFrame, columns: list[str], keys: list[str] = ("cell_id", "date")) -> DataFrame:
    """A digest of (key, value) for each column, whatever the order or join.

    Null values do not count, so a column keeps its digest through an outer
    join. One aggregation serves all columns.
    """
    parts = [c for name in columns for c in (
        F.sum(F.when(F.col(name).isNotNull(), F.xxhash64(*keys, name).cast("decimal(38,0)"))).alias(f"{name}_sum"),
        F.bit_xor(F.when(F.col(name).isNotNull(), F.xxhash64(*keys, name))).alias(f"{name}_xor"),
        F.count(name).alias(f"{name}_n"),
    )]
    wide = rows.agg(*parts)
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"{n}_sum").alias("total"), F.col(f"{n}_xor").alias("mixed"), F.col(f"{n}_n").alias("n")) for n in columns]))
    return wide.select(long.alias("d")).select("d.*")


def digest_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    b = after.select("column", F.col("total").alias("total2"), F.col("mixed").alias("mixed2"), F.col("n").alias("n2"))
    same = F.col("total").eqNullSafe(F.col("total2")) & F.col("mixed").eqNullSafe(F.col("mixed2")) & (F.col("n") == F.col("n2"))
    return before.join(b, "column", "full").filter(~F.coalesce(same, F.lit(False)))


def null_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_null, minimum, maximum for each numeric column."""
    parts = [c for n in columns for c in (F.count_if(F.col(n).isNull()).alias(f"{n}_0"), F.min(F.col(n).cast("double")).alias(f"{n}_1"), F.max(F.col(n).cast("double")).alias(f"{n}_2"))]
    cells = [F.struct(F.lit(n).alias("column"), F.col(f"{n}_0").alias("n_null"), F.col(f"{n}_1").alias("minimum"), F.col(f"{n}_2").alias("maximum")) for n in columns]
    return rows.agg(*parts).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each rule; a null breaks none."""
    wide = rows.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    cells = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_violations")) for n in rules]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def physical_rules() -> dict[str, Column]:
    """Invariants of the reanalysis columns. Plain physical bounds."""
    c = F.col
    return {
        "temperature_order": (c("t2m_min_c") <= c("t2m_c") + 1e-6) & (c("t2m_c") <= c("t2m_max_c") + 1e-6),
        "dew_point": c("dewpoint_c") <= c("t2m_c") + 1e-6,
        "wind": c("wind10m_ms") > 0,
        "radiation": c("srad_down_mj_m2_day").between(0.5, 45),
        "pressure": c("surface_pressure_kpa").between(60, 110),
        "soil": F.array_min(F.array(*[F.coalesce(c(f"swvl{k}").between(0, 1), F.lit(True)) for k in range(1, 5)])),
        "temperature": c("t2m_c").between(-25, 40),
        "precipitation": c("precip_era5_mm") >= 0,
    }


def sign_share(rows: DataFrame, value: str, least_share: float = 0.989, least: float = -3.0) -> DataFrame:
    """Share of positive values and the minimum, with both verdicts."""
    share, low = F.avg((F.col(value) > 0).cast("double")), F.min(value)
    return rows.agg(share.alias("share_positive"), low.alias("minimum"), ((share >= least_share) & (low >= least)).alias("ok"))


def distinct_ratio(rows: DataFrame, value: str, by: Column) -> DataFrame:
    """Distinct values over rows of each group, exact."""
    return rows.groupBy(by.alias("group")).agg((F.count_distinct(value) / F.count(value)).alias("ratio"), F.count(value).alias("n"))


def static_null_sets(rows: DataFrame, value: str) -> int:
    """Number of different sets of null cells over the dates: 1 for a static mask."""
    return null_set_digests(rows, value).select("n", "total", "mixed").distinct().count()


def null_set_digests(rows: DataFrame, value: str) -> DataFrame:
    """For each date the number of its null cells and two digests of their ids; no set is collected."""
    own = F.when(F.col(value).isNull(), F.xxhash64("cell_id"))
    rows = rows.select("date", "cell_id", value).dropDuplicates(["date", "cell_id"])
    return rows.groupBy("date").agg(
        F.count(own).alias("n"),
        F.coalesce(F.sum(own.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"),
        F.coalesce(F.bit_xor(own), F.lit(0).cast("long")).alias("mixed"),
    )


def drift(annual: DataFrame, reference: DataFrame, tolerance: float = 0.02, absurd: float = 2000.0) -> DataFrame:
    """Each year's mean against an independent series: relative drift, whether within tolerance, whether possible."""
    both = annual.select("year", "annual_mean").join(reference.select("year", F.col("annual_mean").alias("reference")), "year", "left")
    off = F.abs(F.try_divide(F.col("annual_mean"), F.col("reference")) - 1)
    return both.select("year", "annual_mean", "reference", off.alias("drift"), F.coalesce(off <= tolerance, F.lit(False)).alias("within"), (F.col("annual_mean") <= absurd).alias("possible"))


def schema_problems(columns: list[tuple[str, str]], expected: dict[str, str]) -> list[str]:
    """Columns that a join has suffixed, that are missing, or that have another type. ``columns``: dtypes."""
    found = dict(columns)
    suffixed = [f"{c}: suffix" for c in found if c.endswith(("_x", "_y", "_left", "_right"))]
    return suffixed + [f"{c}: {found.get(c, 'missing')} for {t}" for c, t in expected.items() if found.get(c) != t]


def subset_check(cells: DataFrame, reference: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Cells that the reference lattice lacks, and whether the two counts are close."""
    ids = reference.select("cell_id").distinct()
    outside = cells.select("cell_id").join(ids, "cell_id", "left_anti").agg(F.count("*").alias("n_outside"))
    counts = cells.agg(F.count("*").alias("n")).join(F.broadcast(ids.agg(F.count("*").alias("n_reference"))))  # one row each
    return counts.join(F.broadcast(outside)).withColumn("close", F.abs(F.try_divide(F.col("n"), F.col("n_reference")) - 1) <= tolerance)


def prediction_checks(rows: DataFrame, actual: str, prediction: str) -> DataFrame:
    """Rows whose binary actual is neither 0 nor 1, whose probability is outside [0, 1], or that have no prediction."""
    return rows.agg(
        F.count_if(F.col(actual).isNotNull() & ~F.col(actual).isin(0.0, 1.0)).alias("n_not_binary"),
        F.count_if((F.col(prediction) < 0) | (F.col(prediction) > 1)).alias("n_outside"),
        F.count_if(F.col(prediction).isNull()).alias("n_missing"),
    )


def base_rate(rows: DataFrame, probability: str, expected: float) -> DataFrame:
    """Mean probability against the one that the index is standardised to."""
    return rows.agg(F.avg(probability).alias("mean"), F.lit(expected).alias("expected"), (F.avg(probability) - expected).alias("drift"))


def persistence_order(rows: DataFrame, now_below: Column, probability: str) -> DataFrame:
    """The most frequent probability of each state; a dry month must make a dry one likelier."""
    modes = rows.agg(
        F.mode(F.when(now_below, F.col(probability)), True).alias("rate_below"),
        F.mode(F.when(~now_below, F.col(probability)), True).alias("rate_above"),
    )
    return modes.withColumn("ok", F.col("rate_below") > F.col("rate_above"))


def row_counts(table: DataFrame, keys: int, splits: dict) -> DataFrame:
    """For each split: rows against keys x months, and rows with a null."""
    months = F.explode(F.array(*[F.struct(F.lit(k).alias("split"), F.lit(p.months * keys).cast("long").alias("expected")) for k, p in splits.items()])).alias("s")
    wanted = table.sparkSession.range(1).select(months).select("s.*")
    some = F.greatest(*[F.col(c).isNull() for c in table.columns if c != "split"])
    found = table.groupBy("split").agg(F.count("*").alias("n"), F.count_if(some).alias("n_with_null"))
    return wanted.join(found, "split", "left").select("split", "expected", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_with_null", F.lit(0)).alias("n_with_null"))


def cross_source(annual_a: DataFrame, annual_b: DataFrame, least_years: int = 5) -> DataFrame:
    """Correlation and relative difference of two annual series; null below five years."""
    both = annual_a.select("year", F.col("annual_mean").alias("a")).join(annual_b.select("year", F.col("annual_mean").alias("b")), "year")
    enough = F.count("*") >= least_years
    return both.agg(
        F.count("*").alias("n_years"),
        F.when(enough, correlation("a", "b")).alias("correlation"),
        (F.abs(F.avg("b") - F.avg("a")) / F.avg("a")).alias("divergence"),
    )


def one_producer(manifests: DataFrame) -> DataFrame:
    """Problems of provenance: sources with several producers, none, or unsaved changes."""
    found = manifests.groupBy("source").agg(
        F.count_distinct("producer_digest").alias("n_producers"),
        F.count_if(F.col("producer_digest").isNull()).alias("n_missing"),
        F.count_if(F.coalesce(F.col("producers_dirty"), F.lit(False))).alias("n_dirty"),
    )
    return found.filter((F.col("n_producers") != 1) | (F.col("n_missing") > 0) | (F.col("n_dirty") > 0))


def lattice_alignment(cells: DataFrame) -> DataFrame:
    """Greatest distance from a lattice point, and ids that don't follow from indices."""
    off = F.greatest(F.abs(F.col("i") - F.rint("i")), F.abs(F.col("j") - F.rint("j")))
    own = F.rint("i").cast("long") * 100_000 + F.rint("j").cast("long")
    return cells.agg(F.max(off).alias("worst"), F.count_if(F.col("cell_id") != own).alias("wrong_ids"))


def unchanged(run, panel: DataFrame, value: str, poisoned_rows: Column, sentinel: float = 999_999.0) -> bool:
    """Whether ``run`` gives the same rows when some values are replaced."""
    poisoned = panel.withColumn(value, F.when(poisoned_rows, F.lit(sentinel)).otherwise(F.col(value)))
    clean, other = run(panel), run(poisoned)
    return clean.exceptAll(other).isEmpty() and other.exceptAll(clean).isEmpty()
