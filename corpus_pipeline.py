"""The corpus pipeline: language ID, quality rules, near copies, packing.

Each stage works on all documents that the one before kept, is written as
Parquet and read again. All but the last return the columns of ``documents``.

Defined results: a null text, or one without letters, goes in the first stage;
of the rest those without 50 words go in the second. Rows with null or repeated
ids are rows like others, and of equal texts one row stays, whatever its id. An
empty table stays empty through all stages; without labels or languages to
learn from only the base rules count, and no language is known. Further columns
are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steppe.llm import jaccard, langid, packing, quality
from steppe.llm.queries import vocabulary
from steppe.llm.shared import materialize, table

#: Never is a language known below this score; the cut-off learned lies above it.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no known language, go."""
    return langid.keep_known(docs, LEAST_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a risk-controlled cut-off go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens with all documents."""
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID, MinHash and packing have no SQL form; a test compares every
#: stage with a plain version, by the rows that stay and by the packed ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
