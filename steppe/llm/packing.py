"""Best-fit packing by patterns fitted with non-negative least squares.

Texts become token ids and pieces of at most ``capacity`` tokens, where Spark
holds them. Only the histogram of piece lengths (at most ``capacity`` numbers,
whatever the input) comes to the driver: patterns of one to three lengths that
fill a sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left over is packed by best
fit, also counted by length. The plan is a bounded list of runs, "so many
sequences with these lengths". A piece then finds its place from its length and
its rank among the pieces of that length, which comes from counts in the task
that cut it and sums over (length, task); no group of pieces meets in one task.

Defined results: a null text counts as empty and is one piece, the closing id;
only documents longer than ``capacity`` are cut; repeated rows and null ids are
packed one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steppe.llm.shared import map_batches, materialize

CAPACITY = 2048
#: Lengths are fitted in so many bins; a pattern fills all of them.
BINS = 256
#: Texts between two spaces that a task remembers with their ids.
CACHE = 1 << 19

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: A normaliser and a pre-tokenizer that treat what stands between
#: two spaces or line feeds by itself, whatever stands around it, and drop both.
APART_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
APART_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
#: Letters that no normal form changes and whose small forms are single letters, then ASCII symbols but no apostrophe.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u045f]+)([!-&(-/:-@\\[-`{-~]*)")
#: Byte-level spelling: bytes that are no visible Latin-1 character are moved beyond it, in order.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}
#: Characters of text that are looked up together.
CHUNK = 1 << 20


def splits_at_spaces(spec: dict) -> bool:
    """Whether the ids of a text are those of what stands between its spaces and line feeds, one after the other."""
    before = spec["pre_tokenizer"] or {}
    steps = before.get("pretokenizers", [before])
    added = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    rest = all(t.get("type") == "ByteLevel" and not t["add_prefix_space"] and not t["use_regex"] for t in steps[1:])
    return added and rest and steps[0] == APART_SPLIT and spec["normalizer"] == APART_NORMALIZER and not (spec["truncation"] or spec["padding"])


class TextIds:
    """Ids of texts, as little-endian unsigned 32-bit numbers, all by the tokenizer itself.

    Where the tokenizer's file says that it treats what stands between spaces
    by itself, such stretches are given to it once and remembered. Plain words
    share the ids of their small letters, which it parts from symbols. Any other
    tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        letters = [c.lower() for c in map(chr, range(0x460)) if PLAIN.fullmatch(c)]
        self.apart = splits_at_spaces(json.loads(self.tokenizer.to_str())) and self._encoded(letters) == [*map(self._stem, letters)]
        self.known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _stem(self, word: str) -> bytes:
        """Ids of small plain letters: one word to the tokenizer's model, in byte-level spelling."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _learn(self, words: set[str]) -> None:
        known, rest, tails = self.known, [], []
        for word in words:
            if word not in known:
                m = PLAIN.fullmatch(word)
                if not m:
                    rest.append(word)
                    continue
                stem, tail = m.groups()
                stem = stem.lower()
                ids = known.get(stem)
                if ids is None:
                    ids = known[stem] = self._stem(stem)
                if tail:
                    own = known.get(tail)
                    if own is None:
                        tails.append((word, ids, tail))
                    else:
                        known[word] = ids + own
                else:
                    known[word] = ids
        rest += {tail for _, _, tail in tails}
        known.update(zip(rest, self._encoded(rest), strict=True))
        for word, ids, tail in tails:
            known[word] = ids + known[tail]

    def _chunk(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return self._encoded(texts)
        if len(self.known) >= CACHE:
            self.known.clear()
        split = [text.replace("\n", " ").split(" ") for text in texts]
        self._learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def of(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; texts are taken together up to ``CHUNK`` characters."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._chunk(held)
                held, size = [], 0
        if held:
            yield from self._chunk(held)


@lru_cache(1)
def text_ids(path: str) -> TextIds:
    """What a Python worker remembers from one task to the next."""
    return TextIds(path)


def _cutter(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = text_ids(path).of, TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of(t.as_py() for t in batch.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    size = len(own) // 4
                    rank = seen.get(size, 0)
                    seen[size] = rank + 1
                    rows.append((doc_id, piece, at // 4, size, zlib.crc32(own), part, rank))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of all documents with their rank among equals of the same task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(map_batches(rows, _cutter(tokenizer, capacity, end_id), PIECES), "pack-pieces")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares with non-negative coefficients, by an active set."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gradient = a.T @ (b - a @ x)
    tiny = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(rounds):
        best = int(np.argmax(np.where(used, -np.inf, gradient)))
        if used.all() or gradient[best] <= tiny:
            break
        used[best] = True
        while True:
            index = np.flatnonzero(used)
            own = a[:, index]
            try:
                fit = np.linalg.solve(own.T @ own + 1e-10 * np.eye(len(index)), own.T @ b)
            except np.linalg.LinAlgError:
                fit = np.linalg.lstsq(own, b, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[index] = fit
                break
            low = fit <= 0
            step = (x[index][low] / np.maximum(x[index][low] - fit[low], 1e-300)).min()
            x[index] += step * (fit - x[index])
            used[index[(x[index] <= 1e-12) & low]] = False
            x[~used] = 0
            if not used.any():
                break
        gradient = a.T @ (b - a @ x)
    return x


def patterns(n_bins: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """One to three bins, longest first, that fill ``n_bins`` exactly."""
    ok = set(np.flatnonzero(present).tolist())
    found = [(n_bins,)] if n_bins in ok else []
    for first in range(n_bins - 1, 0, -1):
        if first not in ok:
            continue
        rest = n_bins - first
        if rest <= first and rest in ok:
            found.append((first, rest))
        for second in range(min(first, rest - 1), (rest + 1) // 2 - 1, -1):
            if second in ok and rest - second in ok:
                found.append((first, second, rest - second))
    return found


class _Bin:
    """Pieces of a bin still to be packed, longest first."""

    def __init__(self, counts: list[list[int]]):
        self.counts = counts
        self.total = sum(c for _, c in counts)

    def take(self, n: int) -> list[tuple[int, int]]:
        taken = []
        self.total -= n
        while n:
            length, count = self.counts[-1]
            k = min(n, count)
            taken.append((length, k))
            n -= k
            if k == count:
                self.counts.pop()
            else:
                self.counts[-1][1] -= k
        return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY, n_bins: int = BINS) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (sequences, lengths in order) that hold exactly the histogram."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    runs = [(left.pop(capacity), (capacity,))] if capacity in left else []
    n_bins = min(n_bins, capacity)
    width = -(-capacity // n_bins)
    n_bins = capacity // width
    counts = np.zeros(n_bins + 1)
    by_bin: dict[int, list[list[int]]] = {}
    for length in sorted(left):
        bin_ = -(-length // width)
        if bin_ <= n_bins:
            counts[bin_] += left[length]
            by_bin.setdefault(bin_, []).append([length, left[length]])
    bins = {b: _Bin(c) for b, c in by_bin.items()}
    found = patterns(n_bins, counts > 0)
    open_runs: list[tuple[int, tuple[int, ...]]] = []
    if found:
        a = np.zeros((n_bins + 1, len(found)))
        for j, pattern in enumerate(found):
            for b in pattern:
                a[b, j] += 1
        weight = np.sqrt(np.arange(n_bins + 1) / n_bins)[:, None]  # a long piece left over costs more
        fitted = np.floor(nnls(a * weight, counts * weight[:, 0]) + 1e-6).astype(int)
        for j in np.argsort(-fitted, kind="stable"):
            need = {b: found[j].count(b) for b in found[j]}
            n = min([int(fitted[j]), *(bins[b].total // k for b, k in need.items())])
            if n > 0:
                open_runs += _zip_runs([bins[b].take(n) for b in found[j]])
    rest = {int(n): 0 for n in left}
    for b in bins.values():
        for length, count in b.counts:
            rest[length] += count
    for length in left:
        if -(-length // width) > n_bins:
            rest[length] += left[length]
    return runs + best_fit(open_runs, rest, capacity)


def _zip_runs(slots: list[list[tuple[int, int]]]) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of equal lengths in each slot, cut where any slot's length changes."""
    out, heads = [], [list(map(list, reversed(s))) for s in slots]
    while heads[0]:
        n = min(h[-1][1] for h in heads)
        out.append((n, tuple(h[-1][0] for h in heads)))
        for h in heads:
            h[-1][1] -= n
            if not h[-1][1]:
                h.pop()
    return out


def best_fit(open_runs: list, rest: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first, of counted lengths into counted sequences."""
    by_room: list[list] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)

    def put(n: int, lengths: tuple[int, ...]) -> None:
        room = capacity - sum(lengths)
        by_room[room].append((n, lengths))
        some[room] = True

    for n, lengths in open_runs:
        put(n, lengths)
    for length in sorted((k for k, v in rest.items() if v), reverse=True):
        count = rest[length]
        while count:
            room = length + int(np.argmax(some[length:]))
            if some[room]:
                n, lengths = by_room[room].pop()
                some[room] = bool(by_room[room])
                k = min(n, count)
                if k < n:
                    put(n - k, lengths)
                put(k, (*lengths, length))
                count -= k
            else:
                many = capacity // length
                k = max(1, count // many)
                size = min(many, count)
                put(k, (length,) * size)
                count -= k * size
    return [run for runs in by_room for run in runs]


def intervals(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length: first rank, first sequence, offset; one row for each place."""
    used: dict[int, int] = {}
    places: dict[int, list] = {}
    first = 0
    for n, lengths in runs:
        offset = 0
        for length in lengths:
            start = used.get(length, 0)
            places.setdefault(length, []).append((start, first, offset))
            used[length] = start + n
            offset += length
        first += n
    return {k: np.array(v, np.int64) for k, v in places.items()}


def _placer(places):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                rows, own = np.flatnonzero(length == size), table[int(size)]
                k = np.searchsorted(own[:, 0], rank[rows], "right") - 1
                sequence[rows] = own[k, 1] + rank[rows] - own[k, 0]
                offset[rows] = own[k, 2]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    return place


def pack(rows: DataFrame, capacity: int = CAPACITY, n_bins: int = BINS) -> DataFrame:
    """Adds sequence_id and offset to the rows of :func:`pieces`.

    Ranks begin where those of the tasks before end: a join on (length, part)
    of narrow rows. That table grows with the tasks, so it is never broadcast;
    no key has more rows than one task cut.
    """
    spark = rows.sparkSession
    counts = materialize(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    places = spark.sparkContext.broadcast(intervals(plan(histogram, capacity, n_bins)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base.hint("merge"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return map_batches(ranked, _placer(places), PLACED)
