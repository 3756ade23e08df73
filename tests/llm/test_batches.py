"""What goes to Python at once is bounded in bytes, and results do not depend on it."""

from __future__ import annotations

import collections

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from steppe.llm import queries, shared

SF = "/root/testdata/sf0.001"
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def setting(spark):
    before = spark.conf.get(SETTING)
    yield lambda value: spark.conf.set(SETTING, value)
    spark.conf.set(SETTING, before)


def test_batches_of_long_texts_are_bounded(spark, setting):
    setting("64m")  # Spark's own
    rows = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("text "), 2_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    found = shared.map_batches(rows, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 2_000
    assert max(r["size"] for r in found) < 1.1 * shared.BATCH_BYTES


@pytest.mark.parametrize("value, kept", [("4k", "4k"), ("1g", None), ("2097152", "2097152")])
def test_a_smaller_bound_of_the_session_holds(spark, setting, value, kept):
    setting(value)
    shared.bound_batches(spark)
    assert spark.conf.get(SETTING) == (kept or f"{shared.BATCH_BYTES}b")


@pytest.mark.parametrize("name", ["op3_language_id", "op4_media_columns", "op8_ngram_jaccard", "op9_best_fit_packing", "op10_sentencepiece", "op12_hard_negatives", "op13_conversation_repair"])
def test_results_do_not_depend_on_batches(spark, setting, name):
    found = []
    for value in ("64m", "3k"):
        setting(value)
        df = getattr(queries, name)(spark, SF)
        if name == "op9_best_fit_packing":  # which of equally good places is not fixed
            df = df.drop("sequence_id", "offset")
        found.append(collections.Counter(map(str, df.collect())))
    assert found[0] == found[1]
