"""Isolated zeros: islands of exact zeros behind a cliff of positive neighbours.

Zero cells of a date are joined in components over eight neighbours. A
component is an artefact when its lowest positive neighbour exceeds the cliff;
one without positive neighbours is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steppe.functions.geo import neighbours
from steppe.storage import materialize

CLIFF_MM = 2.0


def _write(df: DataFrame) -> DataFrame:
    return materialize(df, "zeros")


def components(zeros: DataFrame) -> DataFrame:
    """date, cell_id, component (the least id): least labels spread until none changes."""
    near = _write(neighbours(zeros, ["date"]))
    labels = zeros.select("date", "cell_id", F.col("cell_id").alias("component"))
    while True:
        heard = near.join(labels.select("date", F.col("cell_id").alias("neighbour_id"), "component"), ["date", "neighbour_id"])
        heard = heard.groupBy("date", "cell_id").agg(F.min("component").alias("heard"))
        step = labels.join(heard, ["date", "cell_id"], "left").select("date", "cell_id", F.least("component", "heard").alias("step"), F.col("component").alias("old"))
        jump = labels.select("date", F.col("cell_id").alias("step"), F.col("component").alias("further"))
        fresh = _write(step.join(jump, ["date", "step"]).select("date", "cell_id", F.least("step", "further").alias("component"), "old"))
        labels = fresh.select("date", "cell_id", "component")
        if fresh.filter("component <> old").isEmpty():
            return labels


def labelled_zeros(panel: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Zero cells, and date, cell_id, component of each; both written."""
    zeros = _write(panel.filter(F.col(value) == 0).select("date", "cell_id", "i", "j"))
    return zeros, _write(components(zeros))


def clusters(panel: DataFrame, value: str, cliff: float = CLIFF_MM, labelled: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """date, component, size, boundary_min and artefact of each cluster of zeros.

    ``panel``: cell_id, date, i, j and the value. ``labelled``: from ``labelled_zeros``.
    """
    cells = panel.select("date", "cell_id", "i", "j", F.col(value).alias("v"))
    zeros, found = labelled or labelled_zeros(panel, value)
    positive = cells.filter("v > 0").select("date", "cell_id", "i", "j", "v")
    ring = neighbours_of(zeros, positive).join(found, ["date", "cell_id"]).groupBy("date", "component").agg(F.min("v").alias("boundary_min"))
    sizes = found.groupBy("date", "component").agg(F.count("*").alias("size"))
    rows = sizes.join(ring, ["date", "component"], "left")
    return rows.withColumn("artefact", F.coalesce(F.col("boundary_min") > cliff, F.lit(False)))


def neighbours_of(zeros: DataFrame, positive: DataFrame) -> DataFrame:
    """date, cell_id of a zero cell and value of each positive cell beside it."""
    from steppe.functions.geo import neighbour_offsets

    near = zeros.select("date", "cell_id", F.col("i").alias("_i"), F.col("j").alias("_j"), F.explode(neighbour_offsets()).alias("o"))
    near = near.select("date", "cell_id", (F.col("_i") + F.col("o.di")).alias("i"), (F.col("_j") + F.col("o.dj")).alias("j"))
    return near.join(positive.select("date", "i", "j", "v"), ["date", "i", "j"]).select("date", "cell_id", "v")


def flag_isolated(panel: DataFrame, value: str, cliff: float = CLIFF_MM) -> DataFrame:
    """The panel with a flag for each cell and date inside an artefact."""
    labelled = labelled_zeros(panel, value)
    found = labelled[1]
    bad = clusters(panel, value, cliff, labelled).filter("artefact").select("date", "component")
    marks = found.join(bad, ["date", "component"], "left_semi").select("date", "cell_id", F.lit(True).alias("zero_isolated"))
    return panel.join(marks, ["date", "cell_id"], "left").withColumn("zero_isolated", F.coalesce("zero_isolated", F.lit(False)))


def diagnostics(panel: DataFrame, value: str, cliff: float = CLIFF_MM) -> DataFrame:
    """One row for each date with zeros: counts, the largest cluster, boundaries."""
    bad = F.col("artefact")
    return clusters(panel, value, cliff).groupBy("date").agg(
        F.sum("size").alias("n_zero"),
        F.count("*").alias("n_clusters"),
        F.coalesce(F.sum(F.when(bad, F.col("size"))), F.lit(0)).alias("n_isolated"),
        F.max("size").alias("largest"),
        F.round(F.min(F.when(bad, F.col("boundary_min"))), 4).alias("least_boundary"),
    )


def isolated_share(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count_if("zero_isolated").alias("n_isolated"), F.avg(F.col("zero_isolated").cast("double")).alias("share"))
