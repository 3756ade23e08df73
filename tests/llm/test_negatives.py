"""Hard negatives against all pairs, with small blocks, ties and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steppe.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, anchors, k=5, low=80, high=100):
    rows = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, y, v) in enumerate(rows):
        if not anchors(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, b, z) for b, (j, z, w) in enumerate(rows) if b != a)
        for s, j, _, _ in [x for x in scored if x[3] == y][:k]:
            fits = [x for x in scored if x[3] != y and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, anchors, **sizes):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("number", "block", "vector", "size")})
    ready = negatives.quantized(frame)
    return sorted(tuple(r) for r in negatives.mine(ready, ready.filter(anchors), **sizes).collect())


@pytest.mark.parametrize("chunk", [3, 8, 64])
def test_equal_to_all_pairs(spark, chunk):
    rng = np.random.default_rng(chunk)
    centres = rng.normal(size=(4, 8))
    # three labels and one that a third of all rows have; rounded, so that scores tie
    rows = [(int(i), int(y), [float(round(x, 1)) for x in centres[y] + 0.8 * rng.normal(size=8)]) for i, y in enumerate(rng.choice(4, 150, p=[0.2, 0.2, 0.25, 0.35]))]
    rows += [(500 + i, i % 3, rows[0][2]) for i in range(20)]  # one vector under many ids and labels
    got = mined(spark, rows, "vec_id % 9 = 0", block=37, strip=5, chunk=chunk)
    assert got == brute(rows, lambda i: i % 9 == 0) and len(got) > 100


def test_odd_rows_take_no_part_and_copies_are_rows(spark):
    one, other = [1.0, 0.5, -0.25], [0.9, 0.5, 0.0]
    rows = [
        (0, 1, one), (0, 1, one), (1, 1, one), (2, 2, other), (2, 2, other), (3, None, one), (None, 1, one), (4, 1, None), (5, 2, [1.0, None, 1.0]),
        (6, 2, [1.0, float("nan"), 1.0]), (7, 2, [float("inf"), 1.0, 1.0]), (8, 2, [0.0, 0.0, 0.0]), (9, 3, [-1.0, -1.0, -1.0]),
    ]
    got = mined(spark, rows, "vec_id = 0")
    assert got == brute(rows, lambda i: i == 0) and len(got) == 2 * 2 * 2
    assert mined(spark, [*rows, (10, 1, [1.0])], "vec_id = 0") == got  # another length
    assert mined(spark, rows, "vec_id = 77") == []
    assert mined(spark, [(i, 1, one) for i in range(5)], "vec_id = 0") == []
    empty = negatives.quantized(spark.createDataFrame([], SCHEMA))
    assert negatives.mine(empty, empty).collect() == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, i % 2, [float(i + 1) * 3e5, -2e5 * i, 1e5]) for i in range(12)]
    assert mined(spark, rows, "vec_id < 3", chunk=2) == brute(rows, lambda i: i < 3)
