"""SentencePiece encoding and decoding with a unigram model.

Pieces and log scores come from a model file; the best segmentation is found by
Viterbi over a double-array trie of the pieces' UTF-8 bytes. A character that
no piece covers is spelled in byte pieces, and decoding turns byte pieces and
white-space markers back.

A file of merge ranks instead of log scores (its model type says so) gets
scores by Zipf's law over the ranks.

Spark deals out the texts; a task remembers the ids of words it has seen, since
no piece reaches from one word into the next marker. Models in which one does
are encoded text by text.

Defined results: a null text counts as empty and has no ids; a literal marker
character decodes to a space, as in the public library; null ids and repeated
rows are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steppe.llm.shared import map_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
UNKNOWN_PENALTY = 10.0
CACHE = 1 << 20
ENCODED = "doc_id long, n_chars long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: number and value."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value: object = number()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            size = number()
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class DoubleArray:
    """A trie in two arrays: child = base[node] + byte + 1 where check says node."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value: list[int] = [-1]
        for key, number in keys.items():
            node = 0
            for byte in key:
                node = children[node].setdefault(byte + 1, len(children))
                if node == len(children):
                    children.append({})
                    value.append(-1)
            value[node] = number
        size = 2 * len(children) + 600
        self.base, self.check = [0] * size, [-1] * size
        self.check[0] = 0
        place, free = {0: 0}, 1
        for node in range(len(children)):  # parents come before children
            codes = sorted(children[node]) + ([0] if value[node] >= 0 else [])
            if not codes:
                continue
            while self.check[free] >= 0:
                free += 1
            at = max(1, free - min(codes))
            while True:
                while at + 257 >= len(self.check):
                    self.base += [0] * len(self.base)
                    self.check += [-1] * len(self.check)
                if all(self.check[at + c] < 0 for c in codes):
                    break
                at += 1
            own = place[node]
            self.base[own] = at
            for c in codes:
                self.check[at + c] = own
                if c:
                    place[children[node][c]] = at + c
                else:
                    self.base[at] = -value[node] - 1

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """End and number of each key that starts at a place."""
        base, check, node = self.base, self.check, 0
        for end in range(at, len(data)):
            child = base[node] + data[end] + 1
            if check[child] != node:
                return
            node = child
            leaf = base[node]
            if check[leaf] == node and base[leaf] < 0:
                yield end + 1, -base[leaf] - 1


class Model:
    """Pieces, scores and the trie of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        kind, self.dummy_prefix, self.collapse = UNIGRAM, True, False
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(2):
                    raise ValueError(f"{path} has a normalisation map, which is not applied here")
                self.dummy_prefix, self.collapse = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if kind != UNIGRAM:
            ranks = [-s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
            total = math.log(sum(1 / (r + 1) for r in ranks))
            self.scores = [-math.log(-s + 1) - total if k == NORMAL else s for s, k in zip(self.scores, self.kinds, strict=True)]
        usable = {p.encode(): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER) and p}
        self.trie = DoubleArray(usable)
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
        self.unknown_score = min(normal) - UNKNOWN_PENALTY
        for i, k in enumerate(self.kinds):
            if k == USER:
                self.scores[i] = len(self.pieces[i].encode()) * max(normal) - 0.1
        self.unknown_id = self.kinds.index(UNKNOWN)
        spelled = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [spelled[b] for b in range(256)] if len(spelled) == 256 else None
        self.surface = [self._surface(p, k) for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.word = self._cuts(list(map(bytes.decode, usable)))

    @staticmethod
    def _cuts(pieces: list[str]) -> re.Pattern | None:
        """Where texts can be cut: between characters that no piece joins.

        None if a piece reaches over the start of a word.
        """
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            return None
        alone = "" if any("\n" in p for p in pieces) else "\n"
        first = f"{alone}|" if alone else ""
        pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False) if b in string.punctuation}
        joining = re.escape("".join(sorted({a for a, _ in pairs})))
        letters = rf"[^\W\d_{joining}]++"  # that no piece joins to punctuation
        stops = re.escape(string.punctuation)
        plain = f"{MARK}*{letters}(?=[{MARK}{alone}{stops}]|$)"
        return re.compile(f"{first}{plain}|{MARK}*[^{MARK}{alone}]+|{MARK}+")

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.encode()

    def normalize(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK)

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of normalized text."""
        data = text.encode()
        n = len(data)
        score, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        base, check, scores = self.trie.base, self.trie.check, self.scores
        at = 0
        while at < n:
            byte = data[at]
            size = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            own, node, single = score[at], 0, False
            for end in range(at, n):
                child = base[node] + data[end] + 1
                if check[child] != node:
                    break
                node = child
                leaf = base[node]
                if check[leaf] == node and base[leaf] < 0:
                    number = -base[leaf] - 1
                    total = own + scores[number]
                    if total > score[end + 1]:
                        score[end + 1], back[end + 1], piece[end + 1] = total, at, number
                    single = single or end + 1 - at == size
            if not single:
                total = own + self.unknown_score
                if total > score[at + size]:
                    score[at + size], back[at + size], piece[at + size] = total, at, -1
            at += size
        ids: list[int] = []
        while n > 0:
            if piece[n] >= 0:
                ids.append(piece[n])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(data[back[n] : n])]
            else:
                ids.append(self.unknown_id)
            n = back[n]
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        text = self.normalize(text)
        if self.word is None:
            return self.best(text)
        return [i for w in self.word.findall(text) for i in self.best(w)]

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class WordIds(dict):
    """Ids of words by a model, as little-endian unsigned 32-bit numbers."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.model.best(word), "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = packed
        return packed

    def of(self, text: str) -> bytes:
        text = self.model.normalize(text)
        return b"".join(map(self.__getitem__, self.model.word.findall(text))) if self.model.word else self[text]


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """What a Python worker remembers from one task to the next."""
    return WordIds(Model(path))


def _coder(path: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        model = words.model
        is_byte = np.array([k == BYTE for k in model.kinds])
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                packed = words.of(text)
                ids = np.frombuffer(packed, "<u4")
                back = model.decode(ids.tolist())
                digest = hashlib.sha256(back.encode("utf-8")).hexdigest()
                rows.append((doc_id, len(text), len(ids), int(is_byte[ids].sum()), zlib.crc32(packed), digest, back == text))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 5 + [pa.string(), pa.bool_()]
            names = [c.split()[0] for c in ENCODED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return code


def _ids(path: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            ids = [np.frombuffer(words.of(x.as_py()), "<u4").astype("i4") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return code


def _texts(path: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(path).model
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return code


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and ids of each text."""
    return map_batches(_rows(docs), _ids(model_file), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text from ids."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return map_batches(rows, _texts(model_file), "doc_id long, text string")


def encode_and_check(docs: DataFrame, model_file: str) -> DataFrame:
    """Encodes and decodes each text in one pass; figures and digests of both."""
    return map_batches(_rows(docs), _coder(model_file), ENCODED)
