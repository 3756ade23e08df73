"""Decontamination against a plain search, on odd texts and beyond the broadcast bound."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from steppe.llm import decontaminate

from .helpers import LONG, documents, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    wanted = [(i, tuple(w[k : k + window])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, win in wanted:
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    ids |= {str(item)} if item is not None else set()
        out.append((doc_id, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def found(docs, items, **kind):
    rows = decontaminate.decontaminate(docs, items, **kind).collect()
    for r in rows:
        spans = [(s["start"], s["length"]) for s in r["spans"]]
        assert sum(n for _, n in spans) == r["n_hit"] and all(a + n < b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=repr)


def frames(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("words", "n", "key", "window_id")})
    return with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).withColumns({c: F.lit("x") for c in ("key", "pos", "token", "words", "n_words")}), bench


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, 0])
def test_equal_to_plain_search(spark, broadcast):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "Dé", "e9", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([14, 11, 10, 10, 13, 30])]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    for i in range(12):  # passages, whole and in part, beside one another and overlapping
        item = items[i % 6][1].split(" ")
        cut = item[rng.randint(0, 2) :][: rng.randint(8, 20)]
        docs.append((100 + i, f"{text(5)}, {'-'.join(cut)}! {' '.join(cut)} {text(3)}"))
    docs += [docs[-1]] * 30
    want = brute(docs, items)
    assert sum(r[2] > 0 for r in want) > 30
    assert found(*frames(spark, docs, items), broadcast=broadcast) == want


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, 0])
def test_odd_items_and_texts(spark, broadcast):
    base = "one two three four five six seven eight nine ten eleven"
    items = [(1, base), (1, base), (2, None), (3, ""), (4, " .,! "), (5, "ONE two"), (6, "x y z x y"), (7, "unseen"), (None, "x x x"), (8, base + " twelve")]
    docs = [(1, base), (2, base[4:]), (3, None), (4, ""), (5, "One.Two"), (6, "x y z x y z x y"), (7, "x x x x"), (None, base), (None, base), (8, LONG + " " + base), (9, "on e two one tw o"), (10, "one\x00twoKe")]
    want = brute(docs, items)
    assert found(*frames(spark, docs, items), broadcast=broadcast) == want
    assert next(r for r in want if r[0] == 8)[2:] == (11, ["1", "5", "8"])


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "one two")], [(1, "one two")])
    assert found(docs.limit(0), items) == []
    assert found(docs, items.limit(0)) == [(1, 2, 0, [])]
    assert len(found(with_clashes(documents(spark)), items)) == documents(spark).count()
