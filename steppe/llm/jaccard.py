"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts become sets of five-word shingles (lower case, letters, digits and
underscores). Each set gets a MinHash signature that is read as the paths of
prefix tries, one byte for each of ``DEPTH`` steps: sorted as numbers, the paths
of a trie stand in the order of its leaves. Sets meet in a trie where their
paths share a prefix. The matched prefix begins at full depth and is shortened
step by step, until both the recall that theory guarantees at the threshold and
the recall measured on probe sets reach the target. Where no depth can, there
are more tries.

Sets that share a prefix are a run. All pairs of a run are compared by one bit
of each signature value, a run of many rows in blocks and pairs of blocks, and
what comes out is a spanning forest of the pairs that may reach the threshold
(five deviations below it). Only these connect candidate groups, so documents that
share a passage but are unlike stay apart. Inside a group all pairs are
verified exactly, in blocks: a group of thousands of near copies is many tasks
of two blocks each, and leaves counts, not pairs.

Equal sets are one class from the start, so exact copies cost one row each.
Rows are numbered once, in a written table, and all joins are on that number.

Result: one row for each document with its class (the least id among the
documents that links connect) and the number of different texts it is linked
to (similarity at least the threshold; not counting copies of itself).

Defined results: texts of one to four words have one shingle, all of them;
texts without words, and null texts, are linked to nothing and form classes of
equal texts; rows with a null id take part, and a class of such rows alone has
a null id; repeated rows are copies of each other; different texts may share an
id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steppe.llm.components import connected
from steppe.llm.shared import map_batches, materialize, ship_package

WORDS, THRESHOLD = 5, 0.8
#: Tries, unless the recall needs more; steps of each path; recall of each pair at the threshold.
TREES, DEPTH, RECALL = 24, 8, 0.999
#: Sets, chosen by hash, that are compared with all others to measure the recall.
PROBES = 256
#: Deviations of the estimate below the threshold at which pairs still connect.
DEVIATIONS = 5.0
#: Rows in one block of a run, and of many short runs in one task's group.
RUN = 2048
#: Sets, and shingles, in one block of the exact verification.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
CACHE = 1 << 17
WORD = re.compile(r"\w+")

_MIX = np.random.default_rng(20240607).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "node long, doc_id long, text_key string, set_key string, n_shingles int, paths array<long>, bits binary"


def expected_recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that a pair of that similarity shares a prefix in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def trees_for(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> int:
    """Tries with which prefixes of three steps reach the target recall, ``trees`` at least."""
    while expected_recall(threshold, 3, trees) < recall and trees < 1 << 12:
        trees *= 2
    if expected_recall(threshold, 1, trees) < recall:
        raise ValueError(f"no forest of {trees} tries finds pairs of similarity {threshold} with recall {recall}")
    return trees


def matched_depth(threshold: float, recall: float, trees: int, found: list[int], total: int) -> int:
    """The longest prefix whose guaranteed and measured recall both reach the target.

    ``found``: of ``total`` pairs of probes, how many share a prefix of 1, 2, ... steps.
    """
    depth = DEPTH
    while depth > 1 and (expected_recall(threshold, depth, trees) < recall or found[depth - 1] < recall * total):
        depth -= 1
    return depth


class Shingler:
    """Sorted distinct 64-bit shingles of texts; remembers hashes of words."""

    def __init__(self, size: int = WORDS):
        self.size, self.known = size, {}

    def _word(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        get, own = self.known.get, self._word
        hashes = np.fromiter([get(w) or own(w) for w in words], np.uint64, len(words))
        size = min(self.size, len(hashes))
        if not size:
            return hashes
        n = len(hashes) - size + 1
        total = np.full(n, size, np.uint64)
        for j in range(size):
            total += hashes[j : j + n] * _MIX[j]
            total ^= total >> np.uint64(29)
        return np.unique(total * _MIX[15])


@lru_cache(4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of ``n`` random functions of hashes."""
    rng = np.random.default_rng(20240608)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minhash(shingles: np.ndarray, n: int = TREES * DEPTH) -> np.ndarray:
    """One byte of the least value of each of ``n`` permutations."""
    multiply, add = permutations(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        np.minimum(least, (multiply[:, None] * part + add[:, None]).min(axis=1), out=least)
    return ((least * _MIX[14]) >> np.uint64(56)).astype(np.uint8)


def _signer(trees: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        names = [c.split()[0] for c in SIGNED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            rows = []
            for node, doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = value.as_py()
                own = xxhash.xxh3_128_hexdigest(text)
                shingles = shingler.of(text)
                if len(shingles):
                    values = minhash(shingles, trees * DEPTH)
                    paths = values.view(">u8").astype(np.int64)
                    bits = np.packbits(values & 1).tobytes()
                    rows.append((node, doc_id, own, xxhash.xxh3_128_hexdigest(shingles.tobytes()), len(shingles), paths, bits))
                else:
                    rows.append((node, doc_id, own, "-" + own, 0, [], b""))
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return sign


def most_different(threshold: float, n_bits: int) -> int:
    """Bits that may differ between two sets whose similarity may reach the threshold."""
    alike = (1 + threshold) / 2
    return int(n_bits * (1 - alike) + DEVIATIONS * (n_bits * alike * (1 - alike)) ** 0.5)


def _prober(nodes: list[int], probes: np.ndarray, bits: np.ndarray, threshold: float):
    """Counts pairs of a probe and another set by the longest prefix that some trie shares."""
    most = most_different(threshold, probes.shape[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own = batch.column("paths").flatten().to_numpy().astype(">i8").view(np.uint8).reshape(len(batch), -1)
            own_bits = _bit_rows(batch.column("bits"))
            node = batch.column("node").to_numpy()
            found, total = np.zeros(DEPTH, np.int64), 0
            for k, name in enumerate(nodes):
                near = np.flatnonzero(np.bitwise_count(own_bits ^ bits[k]).sum(axis=1) <= most)
                same = own[near[node[near] != name]] == probes[k]
                alike = (same.mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= threshold
                shared = np.logical_and.accumulate(same[alike].reshape(-1, probes.shape[1] // DEPTH, DEPTH), axis=2)
                found += shared.any(axis=1).sum(axis=0)
                total += int(alike.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["total", "found"])

    return count


def _bit_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least one that the given links reach: no group changes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        fresh = label.copy()
        np.minimum.at(fresh, label[one], label[two])
        np.minimum.at(fresh, label[two], label[one])
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _linker(most: int):
    """A spanning forest of the pairs of each run that differ in at most ``most`` bits."""

    def link(rows: pa.Table) -> pa.Table:
        run = [rows[c].to_numpy() for c in ("right", "left", "key", "tree")]
        order = np.lexsort(run)
        node, block, bits = rows["node"].to_numpy()[order], rows["block"].to_numpy()[order], _bit_rows(rows["bits"])[order]
        one = (run[0] == run[1])[order]
        change = np.flatnonzero(np.any([c[order][1:] != c[order][:-1] for c in run], axis=0)) + 1
        ends = np.concatenate([change, [len(order)]])
        after = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(order)) - 1
        found, held = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0
        gap, at = 1, np.flatnonzero(after >= 1)
        while len(at):
            near = np.bitwise_count(bits[at] ^ bits[at + gap]).sum(axis=1) <= most
            near &= one[at] | (block[at] != block[at + gap])
            a, b = node[at[near]], node[at[near] + gap]
            found = tuple(np.concatenate([x, y]) for x, y in zip(found, (a, b), strict=True))
            held += len(a)
            if held > 1 << 18:
                found, held = _forest(*found), 0
            gap += 1
            at = at[after[at] >= gap]
        a, b = _forest(*found)
        return pa.table({"a": a, "b": b})

    return link


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in place of texts."""
    shingler = Shingler()
    for batch in batches:
        found = pa.array([shingler.of(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
        rows = batch.drop_columns("text")
        yield pa.RecordBatch.from_arrays([*rows.columns, found], names=[*rows.schema.names, "shingles"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products over shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[low:high], column[low:high] - first] = 1
        total += part @ part.T
    sizes = np.array([len(s) for s in sets])
    total[np.diag_indices(len(sets))] = sizes
    return total.astype(np.int64)


def _local_labels(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The least node that links reach inside the block."""
    label = nodes.copy()
    while True:
        near = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        fresh = np.minimum(label, near)
        if (fresh == label).all():
            return label
        label = fresh


def _verifier(threshold: float):
    share = Fraction(str(threshold))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.groupby(["label", "left", "right"], sort=False):
            group = group.drop_duplicates("node")
            nodes, block = group["node"].to_numpy(), group["block"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
            if len(nodes) < 2:
                continue
            inter = intersections(sets)
            sizes = inter.diagonal()
            union = sizes[:, None] + sizes[None, :] - inter
            linked = inter * share.denominator >= union * share.numerator
            np.fill_diagonal(linked, False)
            if group["left"].iloc[0] != group["right"].iloc[0]:
                linked &= block[:, None] != block[None, :]
            if linked.any():
                counts = linked @ group["n_texts"].to_numpy()
                label = _local_labels(linked, nodes)
                some = linked.any(axis=1)
                out.append(pd.DataFrame({"node": nodes[some], "n_links": counts[some], "label": label[some]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "n_links": [], "label": []}).astype("int64")

    return verify


def numbered(docs: DataFrame) -> DataFrame:
    """node, doc_id and text of each row, written once: the numbers stay."""
    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(rows, "near-rows")


def signatures(rows: DataFrame, trees: int = TREES) -> DataFrame:
    return materialize(map_batches(rows.select("node", "doc_id", "text"), _signer(trees), SIGNED), "near-signatures")


def classes(signed: DataFrame) -> DataFrame:
    """Equal sets: set_key, node of the representative, n_texts, least doc_id."""
    texts = signed.groupBy("set_key", "text_key").agg(F.min("node").alias("node"), F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"))
    sets = texts.groupBy("set_key").agg(
        F.min("node").alias("node"), F.count("*").alias("n_texts"), F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles")
    )
    return materialize(sets, "near-sets")


def measured_recall(heads: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES) -> tuple[list[int], int]:
    """Of all pairs of a probe and another set that signatures put at the threshold
    or above: how many share a prefix of 1, 2, ... steps, and how many there are.

    The probes are about ``probes`` sets chosen by hash, compared with every set.
    """
    share = max(1, heads.count() // probes)
    chosen = heads.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(share)) == 0).select("node", "paths", "bits").collect()
    if not chosen:
        return [0] * DEPTH, 0
    paths = np.array([r["paths"] for r in chosen], ">i8").view(np.uint8)
    bits = np.stack([np.frombuffer(r["bits"], np.uint64) for r in chosen])
    counts = map_batches(heads, _prober([r["node"] for r in chosen], paths, bits, threshold), "total long, found array<long>")
    sums = counts.agg(F.sum("total"), *[F.sum(F.col("found")[k]) for k in range(DEPTH)]).collect()[0]
    return [int(x or 0) for x in sums[1:]], int(sums[0] or 0)


def candidates(heads: DataFrame, depth: int, threshold: float, trees: int) -> DataFrame:
    """Candidate links a, b between representatives: forests of the runs of all tries.

    Runs of one row end at the counts. Runs that are long are dealt out in pairs of blocks.
    """
    key = F.shiftrightunsigned("path", 8 * (DEPTH - depth))
    leaves = heads.select("node", "bits", F.posexplode("paths").alias("tree", "path")).select("tree", key.alias("key"), "node", "bits")
    runs = leaves.groupBy("tree", "key").agg(F.count("*").alias("n")).filter("n > 1")
    runs = materialize(runs, "near-runs")
    rows = leaves.join(runs.hint("merge"), ["tree", "key"]).withColumn("blocks", F.ceil(F.col("n") / RUN).cast("int"))
    bins = max(1, (runs.agg(F.sum("n")).collect()[0][0] or 0) // RUN)
    rows = _paired(rows, F.xxhash64("tree", "key"), bins)
    rows = rows.select("tree", "key", "node", "block", "left", "right", "bits", "bin", "pair")
    ship_package(rows.sparkSession)
    linked = rows.groupBy("bin", "pair").applyInArrow(_linker(most_different(threshold, trees * DEPTH)), "a long, b long")
    return materialize(linked, "near-candidates")


def _paired(rows: DataFrame, group, bins: int) -> DataFrame:
    """Each row once for each pair of its group's blocks (column ``blocks``) that has its own.

    Adds block, left, right and what to group by: groups of one block share ``bins`` bins.
    """
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    rows = rows.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(group, F.lit(bins))).otherwise(-1))
    return rows.withColumn("pair", F.when(F.col("blocks") > 1, F.xxhash64(group, "left", "right")).otherwise(0))


def verified(rows: DataFrame, sets: DataFrame, groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, n_links, label for each set and block pair in which it has links."""
    members = groups.join(sets.select("node", "n_texts", "n_shingles"), "node")
    members = materialize(members, "near-members")
    sizes = members.groupBy("label").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    members = members.join(sizes, "label").select("node", "label", "n_texts", blocks.alias("blocks"))
    found = rows.select("node", "text").join(members.hint("merge"), "node")
    found = map_batches(found, _shingle_rows, "node long, label long, n_texts long, blocks int, shingles binary")
    total = sizes.agg(F.sum("size"), F.sum("weight")).collect()[0]
    bins = max(1, (total[0] or 0) // BLOCK, (total[1] or 0) // BLOCK_SHINGLES)
    found = _paired(found, F.xxhash64("label"), bins)
    found = found.select("node", "label", "block", "left", "right", "n_texts", "shingles", "bin", "pair")
    found = found.groupBy("bin", "pair").applyInPandas(_verifier(threshold), "node long, n_links long, label long")
    return materialize(found, "near-links")


def linked_sets(rows: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Signatures of all numbered rows, and set_key, node, label, first_id, n_links of each set."""
    trees = trees_for(threshold, recall)
    signed = signatures(rows, trees)
    sets = classes(signed)
    heads = signed.join(sets.filter("n_shingles > 0").select("node"), "node").select("node", "paths", "bits")
    heads = materialize(heads, "near-heads")
    depth = matched_depth(threshold, recall, trees, *measured_recall(heads, threshold))
    groups = connected(candidates(heads, depth, threshold, trees))
    links = verified(rows, sets, groups, threshold)
    labels = connected(links.select(F.col("node").alias("a"), F.col("label").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    found = sets.join(counts, "node", "left").join(labels, "node", "left").select(
        "set_key",
        "node",
        F.coalesce("label", "node").alias("label"),
        "first_id",
        (F.coalesce("n_links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"),
    )
    return signed, materialize(found, "near-found")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links for each document."""
    signed, found = linked_sets(numbered(docs), threshold, recall)
    firsts = found.groupBy("label").agg(F.min("first_id").alias("class_id"))
    found = found.join(firsts, "label").select("set_key", "class_id", "n_links")
    return signed.select("doc_id", "set_key").join(found, "set_key").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class: the first in the written table, whatever its id.

    Repeated rows, copies without an id and different texts under one id are
    told apart by the number of the row.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.struct("*").alias("row"))
    rows = materialize(rows, "near-rows")
    texts = rows.select("node", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"))
    _, found = linked_sets(texts, threshold, recall)
    kept = found.groupBy("label").agg(F.min("node").alias("node")).select("node")
    return rows.join(kept.hint("merge"), "node", "left_semi").select("row.*")
