"""Hard-negative mining by a two-dimensional block matrix multiply.

Rows are cut into blocks, and vectors into chunks of dimensions. Every anchor
block meets every row block once for each chunk: that product is a partial tile
of scores. Tiles of the same two blocks are shuffled together and added as
int64; of each finished tile only the best rows of each anchor leave, and these
are merged over the row blocks.

This runs twice. First over the tiles whose blocks share a label, for the
positives of each anchor: its best rows of the same label. Each of them spans a
window of scores, from ``low`` to ``high`` hundredths of its own; then, over all
tiles with two labels, the best rows of other labels are taken in each window.
Rows are dealt to blocks in order of labels, so the first run meets a small part
of the tiles and the second leaves out those of one label only.

Blocks have at most ``ROWS`` rows, strips of anchors ``ANCHORS``: a tile is
``ANCHORS * ROWS * 8`` bytes, whatever the input. A label with a third of all
rows fills more blocks, not larger ones. Partial tiles are stored in the least
width of integers that holds them.

Defined results: rows with a null id, label or vector, with another length than
``dims``, or with a null or non-finite component take no part; without ``dims``
the commonest length of the other rows holds. Rows are rows: of repeated ids each
is an anchor, a positive or a negative of its own, and a copy of the anchor is
another row. Ties go to the smaller id. An empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steppe.llm.shared import map_batches, materialize

ANCHORS, ROWS, CHUNK = 128, 8192, 32
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
SCALE = 256
BLOCKS = "block long, chunk int, n int, ids binary, labels binary, numbers binary, data binary, first long, last long"
TILES = "a long, b long, chunk int, data binary"
BEST = "a long, scores binary, ids binary, numbers binary"
POSITIVE = "number long, anchor_id long, positive_id long, rank int, score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
NONE = np.iinfo(np.int64).min


def quantized(embeddings: DataFrame, dims: int | None = None) -> DataFrame:
    """vec_id, label and vector (integers) of the rows that take part, numbered and written once."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    value = F.transform("v", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    rows = rows.select("vec_id", "label", value.alias("vector")).withColumn("size", F.size("vector"))
    # in order of labels; the id divides a label with many rows
    rows = rows.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id")
    rows = materialize(rows.withColumn("number", F.monotonically_increasing_id()), "neg-rows")
    if dims is None:
        most = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
        dims = most["size"] if most else 0
    return rows.filter(F.col("size") == dims).drop("size")


def _ints(x: np.ndarray) -> bytes:
    """In the least of three widths that holds all, with its size first."""
    x = np.ascontiguousarray(x)
    most = int(np.abs(x).max()) if x.size else 0
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _long(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _out(columns: list, ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack_batches(batches: Iterator[pa.RecordBatch], size: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows as blocks of ``size``, a row of output for each chunk of dimensions."""
    held: list[pa.RecordBatch] = []

    def block(n: int) -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.Table.from_batches(held)
        now, rest = table.slice(0, n).combine_chunks(), table.slice(n)
        held = rest.to_batches()
        ids, labels, numbers = (now.column(c).to_numpy() for c in ("vec_id", "label", "number"))
        vectors = now.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        for k in range(0, max(1, vectors.shape[1]), chunk):
            row = [int(numbers[0]), k // chunk, len(ids), ids.tobytes(), labels.tobytes(), numbers.tobytes(), _ints(vectors[:, k : k + chunk]), int(labels.min()), int(labels.max())]
            yield _out([[x] for x in row], BLOCKS)

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= size:
            yield from block(size)
    if sum(b.num_rows for b in held):
        yield from block(size)


def blocks(rows: DataFrame, size: int, chunk: int) -> DataFrame:
    """``BLOCKS``: block (the number of its first row), chunk, ids, labels and components."""
    return materialize(map_batches(rows.select("vec_id", "label", "number", "vector"), partial(pack_batches, size=size, chunk=chunk), BLOCKS), "neg-blocks")


def multiply_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial tile of two blocks and a chunk. Products of doubles are exact up to 2^53."""
    for batch in batches:
        for a, b, chunk, n, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "chunk", "n", "left", "right")), strict=True):
            x, y = _long(left).reshape(n, -1), _long(right)
            y = y.reshape(-1, x.shape[1]) if x.shape[1] else np.zeros((0, 0), np.int64)
            bound = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1]
            tile = (x.astype(float) @ y.astype(float).T).astype(np.int64) if bound < 1 << 53 else x @ y.T
            yield _out([[a], [b], [chunk], [_ints(tile)]], TILES)


def tiles(anchors: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Partial tiles of the given pairs of blocks (a, b), for every chunk."""
    left = anchors.select(F.col("block").alias("a"), "chunk", "n", F.col("data").alias("left"))
    right = rows.select(F.col("block").alias("b"), "chunk", F.col("data").alias("right"))
    left = pairs.join(left, "a").select("a", "b", "chunk", "n", "left")
    return map_batches(left.join(right.hint("merge"), ["b", "chunk"]), multiply_batches, TILES)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, in order; ties go to the earlier place."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.argsort(-scores[at], kind="stable")][:k]


def _in_windows(scores: np.ndarray, spans: np.ndarray, k: int, low: int, high: int) -> list[np.ndarray]:
    """The same for each window: scores from ``low`` to ``high`` hundredths of a span."""
    bounds = [(-(-low * int(x) // 100), high * int(x) // 100) if x != NONE else (1, 0) for x in spans]
    live = [x for x in bounds if x[0] <= x[1]]
    if not live:
        return [np.zeros(0, int)] * len(spans)
    at = np.flatnonzero((scores >= min(x[0] for x in live)) & (scores <= max(x[1] for x in live)))
    at = at[np.argsort(-scores[at], kind="stable")]
    falling, out = -scores[at], []
    for least, most in bounds:
        begin, end = (np.searchsorted(falling, -most), np.searchsorted(falling, -least, "right")) if least <= most else (0, 0)
        out.append(at[begin : min(end, begin + k)])
    return out


def reduce_batches(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int, windows: bool) -> Iterator[pa.RecordBatch]:
    """Adds the tiles of two blocks, and takes the best rows of each anchor, or of each of its windows.

    Tiles of two blocks come one after another, the row with ids and labels first.
    """
    now, head, tile = None, None, None

    def best() -> pa.RecordBatch:
        mine, own, ids, labels, numbers, spans = head
        order = np.lexsort((numbers, ids))  # earlier places win ties
        ids, labels, numbers = ids[order], labels[order], numbers[order]
        table = tile.reshape(len(mine), len(ids))[:, order]
        width = spans.shape[1] if windows else 1
        out = [np.full((len(mine), width, k), NONE) for _ in range(3)]
        for i in range(len(mine)):
            at = np.flatnonzero(labels != own[i] if windows else (labels == own[i]) & (numbers != mine[i]))
            scores = table[i, at]
            found = _in_windows(scores, spans[i], k, low, high) if windows else [_best(scores, k)]
            for w, picked in enumerate(found):
                for x, values in zip(out, (scores, ids[at], numbers[at]), strict=True):
                    x[i, w, : len(picked)] = values[picked]
        return _out([[now[0]], *[[x.tobytes()] for x in out]], BEST)

    for batch in batches:
        for a, b, chunk, data, mine, own, ids, labels, numbers, spans in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "chunk", "data", "mine", "own", "ids", "labels", "numbers", "spans")), strict=True):
            if (a, b) != now:
                if now is not None:
                    yield best()
                now, tile = (a, b), None
            if chunk < 0:
                head = [np.frombuffer(x, np.int64) for x in (mine, own, ids, labels, numbers)]
                head.append(np.frombuffer(spans, np.int64).reshape(len(head[0]), -1) if windows else None)
            else:
                part = _long(data)
                tile = part if tile is None else tile + part
    if now is not None:
        yield best()


def merge_batches(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """The best of all tiles of an anchor block, which come one after another."""
    now, best = None, None

    def out() -> pa.RecordBatch:
        return _out([[now], *[[np.ascontiguousarray(x).tobytes()] for x in best]], BEST)

    for batch in batches:
        for a, *fresh in zip(*(batch.column(c).to_pylist() for c in ("a", "scores", "ids", "numbers")), strict=True):
            scores, ids, numbers = (np.frombuffer(x, np.int64).reshape(-1, width, k) for x in fresh)
            if a != now:
                if now is not None:
                    yield out()
                now, best = a, (scores, ids, numbers)
                continue
            scores, ids, numbers = (np.concatenate(x, axis=2) for x in zip(best, (scores, ids, numbers), strict=True))
            order = np.lexsort((numbers, ids, -np.maximum(scores, NONE + 1)), axis=2)[:, :, :k]
            best = tuple(np.take_along_axis(x, order, 2) for x in (scores, ids, numbers))
    if now is not None:
        yield out()


def best_rows(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, spans: DataFrame | None = None, width: int = 1, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``BEST``: for each anchor block, k rows of each anchor (or of each window of it, by ``spans``)."""
    none = F.lit(None).cast("binary")
    heads = anchors.filter("chunk = 0").select(F.col("block").alias("a"), F.col("numbers").alias("mine"), F.col("labels").alias("own"))
    heads = heads.join(spans, "a") if spans is not None else heads.withColumn("spans", none)
    own = rows.filter("chunk = 0").select(F.col("block").alias("b"), "ids", "labels", "numbers")
    heads = pairs.join(heads, "a").join(own, "b").withColumns({"chunk": F.lit(-1), "data": none})
    parts = tiles(anchors, rows, pairs).withColumns({c: none for c in ("mine", "own", "ids", "labels", "numbers", "spans")})
    joined = parts.unionByName(heads).repartition("a", "b").sortWithinPartitions("a", "b", "chunk")
    reduced = map_batches(joined, partial(reduce_batches, k=k, low=low, high=high, windows=spans is not None), BEST)
    merged = reduced.repartition("a").sortWithinPartitions("a")
    return map_batches(merged, partial(merge_batches, k=k, width=width), BEST)


def mined_batches(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Packed results as rows."""
    for batch in batches:
        for scores, ids, anchors, positives, spans in zip(*(batch.column(c).to_pylist() for c in ("scores", "ids", "anchors", "positives", "spans")), strict=True):
            scores, ids = (np.frombuffer(x, np.int64).reshape(-1, width, k) for x in (scores, ids))
            anchors, positives, spans = np.frombuffer(anchors, np.int64), *(np.frombuffer(x, np.int64).reshape(-1, width) for x in (positives, spans))
            i, w, rank = np.nonzero(scores != NONE)
            yield _out([anchors[i], positives[i, w], rank + 1, ids[i, w, rank], spans[i, w], scores[i, w, rank]], MINED)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    block: int = ROWS, strip: int = ANCHORS, chunk: int = CHUNK,
) -> DataFrame:
    """The hard negatives of each anchor and positive (``MINED``).

    ``rows`` and ``anchors``, a part of them: vec_id, label, vector and number,
    as ``quantized`` makes them.
    """
    many = blocks(rows.sortWithinPartitions("label", "vec_id"), block, chunk)
    few = blocks(anchors.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id"), strip, chunk)
    a = few.filter("chunk = 0").select(F.col("block").alias("a"), F.col("first").alias("a_first"), F.col("last").alias("a_last"))
    b = many.filter("chunk = 0").select(F.col("block").alias("b"), F.col("first").alias("b_first"), F.col("last").alias("b_last"))
    grid = max(1, b.count())  # every strip goes to all columns of the grid, every row block to one
    a = a.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    pairs = materialize(a.join(b.withColumn("column", F.pmod(F.xxhash64("b"), F.lit(grid)).cast("int")), "column"), "neg-pairs")
    share = (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))
    one = (F.col("a_first") == F.col("b_last")) & (F.col("a_last") == F.col("b_first"))
    found = materialize(best_rows(few, many, pairs.filter(share).select("a", "b"), positives), "neg-positives")
    spans = found.select("a", F.col("scores").alias("spans"))
    best = best_rows(few, many, pairs.filter(~one).select("a", "b"), negatives, spans, positives, low, high)
    known = found.select("a", F.col("ids").alias("positives"), F.col("scores").alias("spans"))
    ids = few.filter("chunk = 0").select(F.col("block").alias("a"), F.col("ids").alias("anchors"))
    done = best.join(known, "a").join(ids, "a").select("scores", "ids", "anchors", "positives", "spans")
    return map_batches(done, partial(mined_batches, width=positives, k=negatives), MINED)
