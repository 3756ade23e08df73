"""Benchmark decontamination: a prefix-filtered set join (DataFrame functions only).

Every benchmark item is cut into windows of ``WINDOW`` consecutive words; one
with fewer is one window. A window is the set of its shingles of ``SHINGLE``
words (shorter windows: one shingle of all words). A document holds the window
only if it holds all of them, so of the shingles in order of rarity a prefix of
one, the rarest, is necessary. Windows with a shingle that no document has are
out at once.

Steps: (1) one pass over the texts finds where any benchmark shingle stands;
these places are written, with the words around them. (2) Their counts, over all documents,
give the order of rarity and each window's prefix. (3) Places of prefix shingles
make candidates (text, start, window); the positional bound (the start may not
lie before the text) and the length bound (the window may not end behind it)
drop some. (4) Candidates are verified word by word.

The shingles of the benchmark are broadcast if there are at most ``BROADCAST``,
and no text is shuffled. Beyond that a merge join finds the places, which then
have no words around them; the texts of candidates are read again for the last
step, equal ones once.

Defined results: null texts have no words; rows without an item id make hits
but are not listed; equal ids of several items count once; repeated documents
have a row each; empty tables give no rows, or no hits; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from steppe.llm.shared import let, materialize

WINDOW, SHINGLE = 10, 5
#: The most shingles (16 bytes each, or 32 MB as a hash table) that are sent to all executors.
BROADCAST = 500_000
#: All characters below 128 that are no digit and no lower-case letter end a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), SEPARATORS), "")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _token(words: Column, size: int) -> Callable[[Column], Column]:
    """The shingle of ``size`` words that begins at a place, as a function of the place."""
    return lambda at: F.xxhash64(F.lit(size), *[words[at + i] for i in range(size)])


def windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The different windows (window_id, words, n), and the items of each (window_id, item_id)."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    rows = rows.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), F.lit(window)).alias("words"))
    rows = rows.withColumn("window_id", F.sha2(F.array_join("words", " "), 256))  # no word holds a space
    rows = materialize(rows, "bench-windows")
    return rows.select("window_id", "words", F.size("words").alias("n")).dropDuplicates(["window_id"]), rows.select("window_id", "item_id").distinct()


def shingles(found: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """window_id, n, token and at (where in the window it stands) of every window's shingles."""
    tokens = F.lit(None).cast("array<bigint>")
    for size in range(shingle, 0, -1):
        own = F.transform(F.sequence(F.lit(0), F.col("n") - size), _token(F.col("words"), size))
        tokens = F.when(F.least("n", F.lit(shingle)) == size, own).otherwise(tokens)
    return found.select("window_id", "n", F.posexplode(tokens).alias("at", "token"))


def places(docs: DataFrame, tokens: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast: int = BROADCAST) -> DataFrame:
    """Where benchmark shingles stand in the documents, and one row for every document.

    doc_id, key, n_words, pos, token, first and near: the words that any window
    with this shingle could have here, from word ``first`` on. The row of a
    document itself is at ``pos`` -1, without a token.
    """
    sizes = sorted(r[0] for r in tokens.select(F.least("n", F.lit(shingle)).alias("size")).distinct().collect())  # five at most
    known = materialize(tokens.select(F.col("token").alias("known")).distinct(), "bench-tokens")

    def entry(pos: Column, token: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), token.alias("token"))

    def entries(words: Column) -> Column:
        found = F.array(entry(F.lit(-1), F.lit(None).cast("long")))
        for size in sizes:
            starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
            token = _token(words, size)
            found = F.concat(found, F.transform(starts, lambda i: entry(i, token(i))))  # noqa: B023
        return found

    found = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), w.alias("words"), entries(w).alias("entries")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), found.alias("f"))
    rows = rows.select("doc_id", "key", F.col("f.n_words").alias("n_words"), "f.words", F.inline("f.entries"))
    first = F.greatest(F.col("pos") - (window - shingle), F.lit(0))
    if known.count() <= broadcast:
        rows = rows.join(F.broadcast(known), F.col("token") == F.col("known"), "left").filter(F.col("known").isNotNull() | (F.col("pos") < 0))
        near = F.when(F.col("pos") >= 0, F.slice("words", first + 1, F.col("pos") - first + window))
        return materialize(rows.select("doc_id", "key", "n_words", "pos", "token", first.alias("first"), near.alias("near")), "bench-places")
    rows = rows.select("doc_id", "key", "n_words", "pos", "token", first.alias("first"), F.lit(None).cast("array<string>").alias("near"))
    hits = rows.join(known.hint("merge"), F.col("token") == F.col("known")).drop("known")  # rows of documents have no token to join by
    return materialize(hits.unionByName(rows.filter("pos < 0")), "bench-places")


def prefixes(tokens: DataFrame, hits: DataFrame) -> DataFrame:
    """window_id, n, token and at of each window's rarest shingle, where all of its shingles occur."""
    counts = hits.groupBy("token").agg(F.count("*").alias("places"))
    ranked = tokens.join(counts, "token", "left").groupBy("window_id", "n")
    ranked = ranked.agg(F.min(F.struct("places", "token", "at")).alias("first"), F.count_if(F.col("places").isNull()).alias("missing"))
    return ranked.filter("missing = 0").select("window_id", "n", "first.token", "first.at")


def occurrences(docs: DataFrame, hits: DataFrame, found: DataFrame, rarest: DataFrame) -> DataFrame:
    """key, start, n and window_id of every window that a text holds, verified by its words."""
    rows = hits.join(rarest, "token").withColumn("start", F.col("pos") - F.col("at"))
    rows = rows.filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    rows = rows.join(found.select("window_id", "words"), "window_id")
    own = F.slice("near", F.col("start") - F.col("first") + 1, F.col("n"))
    rows = rows.filter(F.col("near").isNull() | (own == F.col("words")))
    rows = materialize(rows.groupBy("key", "start", "n", "window_id").agg(F.bool_or(F.col("near").isNull()).alias("open")), "bench-candidates")
    done, rest = rows.filter("NOT open"), rows.filter("open")
    if rest.isEmpty():
        return done.drop("open")
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(rest.select("key").distinct(), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text")).select("key", words_of(F.col("text")).alias("own"))
    rest = rest.join(found.select("window_id", "words"), "window_id").join(texts, "key")
    rest = rest.filter(F.slice("own", F.col("start") + 1, F.col("n")) == F.col("words"))
    return done.unionByName(rest.select(*done.columns)).drop("open")


def spans(found: DataFrame) -> DataFrame:
    """key, n_hit and spans (start and length in words, apart from one another) of each text."""
    before = W.partitionBy("key").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ends = found.groupBy("key", "start").agg(F.max("n").alias("n")).withColumn("end", F.col("start") + F.col("n"))
    ends = ends.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)))
    ends = ends.withColumn("span", F.count_if("fresh").over(W.partitionBy("key").orderBy("start")))
    merged = ends.groupBy("key", "span").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    return merged.groupBy("key").agg(F.sum("length").cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast: int = BROADCAST) -> DataFrame:
    """Each document with the benchmark words that it holds.

    Output: doc_id, n_words, n_hit, items (ids in string order) and spans (start
    and length in words).
    """
    found, members = windows(items, window)
    tokens = materialize(shingles(found, shingle), "bench-shingles")
    rows = places(docs, tokens, window, shingle, broadcast)
    hits = rows.filter("pos >= 0").drop("doc_id")
    held = materialize(occurrences(docs, hits, found, prefixes(tokens, hits)), "bench-occurrences")
    listed = held.select("key", "window_id").distinct().join(members.filter("item_id IS NOT NULL"), "window_id")
    listed = listed.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    texts = materialize(spans(held).join(listed, "key", "left"), "bench-texts")
    done = rows.filter("pos < 0").join(texts, "key", "left")
    return done.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
    )
