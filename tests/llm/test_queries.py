"""Registered queries against their SQL, and what has none against its contract."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    from oracle import connect

    return connect(SF)


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op5_url_filters", "op6_quality_rules", "op7_warc_revisits", "op8_ngram_jaccard", "op11_decontamination", "op12_hard_negatives", "op13_conversation_repair"])
def test_query_matches_sql(spark, con, name):
    from oracle import differences

    from steppe.llm.registry import ORACLES, QUERIES

    assert not differences(spark, con, SF, QUERIES[name], ORACLES[name])


def test_held_out_accuracy(spark):
    from steppe.llm.queries import op3_language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op3_language_id(spark, SF).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_pipeline_keeps_columns_and_applies_every_stage(spark):
    import corpus_pipeline
    from steppe.llm.shared import materialize, table

    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
