"""The panel concepts on the driver's tables.

A supplier is a cell, a month of shipping a date, quantities are amounts of
precipitation (those of returned lines have zeros), prices a second source.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steppe.config import Config, Period, Target
from steppe.operators import panel as P

START, END = date(1995, 1, 1), date(2001, 10, 1)
DRY = 150.0
SPLITS = {
    "train": Period(START, date(1999, 12, 1)),
    "validation": Period(date(2000, 4, 1), date(2000, 9, 1)),
    "test": Period(date(2001, 1, 1), END),
}
FIT = SPLITS["train"]
CONFIG = Config(FIT, SPLITS, (Target("spi_1", 1), Target("spi_3", 3, "classification", -1.0)), gap_months=3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole months, with the keys of the panel."""
    rows = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    inside = (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("2001-11-01").cast("timestamp_ntz"))
    return rows.filter(inside).withColumn("cell_id", F.col("l_suppkey")).withColumn("date", F.trunc(day, "month"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, date, precip, sparse, price, n_obs where there are lines."""
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    return lines(spark, sf_dir).groupBy("cell_id", "date").agg(
        F.sum("l_quantity").alias("precip"), returned.alias("sparse"), price.alias("price"), F.count("*").alias("n_obs")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier in every month; missing amounts are exact zeros."""
    return P.densify(monthly(spark, sf_dir), START, END, {"precip": 0.0, "sparse": 0.0, "n_obs": 0})


def source(spark: SparkSession, sf_dir: str, flag: str, name: str) -> DataFrame:
    rows = lines(spark, sf_dir).filter(F.col("l_returnflag") == flag)
    return rows.groupBy("cell_id", "date").agg(F.sum("l_quantity").alias(name))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier dimension: membership, cropland, lattice, coordinates."""
    rows = table(spark, sf_dir, "supplier")
    return rows.select(
        F.col("s_suppkey").alias("cell_id"),
        F.floor(F.col("s_suppkey") / 10).cast("long").alias("i"),
        (F.col("s_suppkey") % 10).cast("long").alias("j"),
        (30 + F.floor(F.col("s_suppkey") / 10) * 0.05).alias("lon"),
        (37 + (F.col("s_suppkey") % 10) * 0.05).alias("lat"),
        ((F.col("s_acctbal") + 1000) / 11000).alias("crop_frac"),
        (F.col("s_nationkey") < 20).alias("in_basin"),
        (F.col("s_nationkey") % 7 == 0).alias("in_lobe"),
        F.col("s_nationkey").alias("nation"),
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with lattice indices."""
    rows = panel(spark, sf_dir)
    return rows.withColumn("i", F.floor(F.col("cell_id") / 10).cast("long")).withColumn("j", (F.col("cell_id") % 10).cast("long"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
