"""The streamed panel equals the batch panel on shuffled and late input."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from steppe.operators import panel as P
from steppe.streaming import densify as D

SCHEMA = "cell_id long, ts timestamp, value double"


def test_streamed_panel_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    start, rows = datetime(2001, 1, 1), []
    for cell, gap in ((1, 1), (2, 45), (3, 130)):  # every day, with empty months, with long silence
        rows += [(cell, start + timedelta(days=d, hours=rng.randint(0, 23)), float(rng.randint(0, 9))) for d in range(0, 300, gap)]
    rows += [(2, start + timedelta(days=100), None), (3, datetime(2000, 12, 5), 7.0), (None, start, 1.0)]
    batches = [sorted((r for r in rows if (r[1] - start).days // 60 == k), key=lambda _: rng.random()) for k in range(-1, 5)]
    late = [(1, start + timedelta(days=3), 99.0), (2, start + timedelta(days=20), 99.0)]  # half a year after they were due
    batches[-2] += late
    last = [(1, datetime(2001, 12, 20), 1.0)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, batch in enumerate([*batches, last]):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            query = D.densified(source, date(2001, 1, 1)).writeStream.outputMode("append").format("parquet")
            query = query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
            dropped = D.late_rows(query) if k == len(batches) - 2 else None
            if dropped is not None:
                assert dropped == len(late)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(str(tmp_path / "out"))
    frame = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA).filter("ts >= TIMESTAMP '2001-01-01'")
    monthly = frame.groupBy("cell_id", F.trunc("ts", "month").alias("date")).agg(F.sum("value").alias("value"), F.count("*").alias("n_obs"))
    want = P.densify(monthly, date(2001, 1, 1), date(2001, 11, 1), {"n_obs": 0})
    assert sorted(map(str, got.select("cell_id", "date", "value", "n_obs").collect())) == sorted(map(str, want.select("cell_id", "date", "value", "n_obs").collect()))
    assert got.filter("value IS NULL").count() > 5
