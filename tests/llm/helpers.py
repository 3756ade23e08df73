"""Small tables with all the cases that operators must bear."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} und der the" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old garden near a quiet river"
NEAR = BASE + " today"

ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, NEAR, "en", "b"),
    (4, None, "en", None),
    (5, "", None, "a"),
    (6, "   \n\t ", "de", "a"),
    (7, LONG, "en", "c"),
    (8, "12345 678 !!", "fr", "c"),
    (9, "Straße größer als der Garten", "de", "c"),
    (10, "日本語のテキスト \U0001f600", None, "d"),
    (None, "no id at all here", "en", "d"),
    (None, "no id at all here", "en", "d"),
    (11, "one two", "en", "d"),
    (12, "a\x00b \\<|im_end|> <\\|x", "en", "d"),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, k, s, None if t is None else len(t)) for i, t, k, s in rows], DOCS)


def with_clashes(df):
    """Extra columns named like those that operators add."""
    from pyspark.sql import functions as F

    names = ["size", "slot", "shard", "label", "node", "part", "rank", "_w", "_kept", "_language", "_row", "set_key", "score", "path", "host", "data"]
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})
