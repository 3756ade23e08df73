"""Helpers that every operator of the subpackage uses."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steppe.storage import materialize, scratch_path, shared_dir

__all__ = ["let", "map_batches", "materialize", "scratch_path", "shared_dir", "ship_package", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to Python at once; a row may have more by itself.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each application.

    Their functions refer to its modules, which need not be installed there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have about ``BATCH_BYTES`` at most, or less if it says so.

    Texts are long, so Spark's default number of rows makes one batch of a whole
    partition, which the JVM holds outside its heap and each Python worker again.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if now > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with a function of this package, in batches of bounded size."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]
