"""Daily observations as a stream: sums of each key and window, with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(stream: DataFrame, key: str, time: str, value: str, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Sum and count of each key and tumbling window; later rows are dropped."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    found = rows.groupBy(F.window(time, window).alias("w"), F.col(key)).agg(F.sum(value).alias("total"), F.count("*").alias("n_obs"))
    return found.select(F.col("w.start").alias("start"), key, "total", "n_obs")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", lateness: str = "2 days") -> DataFrame:
    """Spells of each key without a gap: start, end and number of rows."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    found = rows.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n_obs"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_obs")


def run_available(frame: DataFrame, checkpoint: str, path: str) -> None:
    """Processes what is there and stops; windows that are not closed yet wait."""
    query = frame.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
