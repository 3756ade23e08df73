"""Media columns: content-addressed payloads in tar shards.

Each task appends its media files to tar shards of its own in the shared
folder; a row carries digest, shard, offset and length, and equal contents have
one address in the whole table. Metadata come from range reads of the headers
alone, features from range reads of the payloads. No media pass the driver.

Hashes of the contents are counted first. Contents in a bucket of hashes where
none occurs twice are stored where they are read. The others are combined by
digest before they are shuffled, so a content of very many rows is one for each
task, stored once, and its address is joined back to the narrow rows.

The stored form is an 8-bit greyscale PNG, 64 samples wide, filter 0, zlib.

Shards have names of their own for each attempt of a task, so a repeated task
never touches files that others read; rows of a lost attempt are never
committed, and neither are their addresses.

Defined results: a null text is stored as an empty one (64 zero bytes); equal
texts have equal digests, sizes and features; null ids and repeated rows are
kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steppe.llm.shared import map_batches, materialize, scratch_path

WIDTH = 64
#: Bytes after which a task begins another shard (and forgets what the last one holds).
SHARD_BYTES = 256 << 20
#: Buckets of hashes: the table of those with repeated contents has so many rows at most, and is broadcast.
BUCKETS = 1 << 20
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"

PLACE = "n_bytes long, digest string, shard string, offset long, length long"
ADDRESS = "doc_id long, " + PLACE
HEADER = ADDRESS + ", width int, height int, bit_depth int, color_type int"
CONTENT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, width int, height int, bit_depth int, shard string, offset long"
)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a PNG."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG that :func:`encode_png` made."""
    width, height, depth, color = decode_header(media[:HEADER_BYTES])
    if (depth, color) != (8, 0):
        raise ValueError("only 8-bit greyscale is read here")
    data, at = [], 8
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind = media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only filter 0 is read here")
    return rows[:, 1:].tobytes()


def pad(data: bytes) -> bytes:
    size = max(1, -(-len(data) // WIDTH)) * WIDTH
    return data + bytes(size - len(data))


def feature(samples: bytes) -> str:
    """Per-mille shares of the samples in sixteen equal bins of their value."""
    counts = np.bincount(np.frombuffer(samples, np.uint8) >> 4, minlength=16)
    return ",".join(map(str, (counts * 1000 // len(samples)).tolist()))


class _Shard:
    """A tar file that one task writes."""

    def __init__(self, root: str):
        self.name = f"{root}/shard-{uuid.uuid4().hex}.tar"
        files, path = fs.FileSystem.from_uri(self.name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.places = files.open_output_stream(path), 0, {}

    def put(self, digest: str, media: bytes) -> int:
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + media + bytes(-len(media) % 512))
            self.places[digest] = self.at + len(head)
            self.at += len(head) + len(media) + -len(media) % 512
        return self.places[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def _writer(root: str, shard_bytes: int):
    """Stores the contents in the second column; the first one stays beside their addresses."""
    schema = pa.schema([("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            rows = []
            for data in batch.column(1):
                raw = data.as_py()
                media = encode_png(pad(raw))
                digest = hashlib.sha256(media).hexdigest()
                if shard is not None and shard.at > shard_bytes:
                    shard.close()
                    shard = None
                shard = shard or _Shard(root)
                rows.append((len(raw), digest, shard.name, shard.put(digest, media), len(media)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            places = [pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *places], names=[batch.schema.names[0], *schema.names])
        if shard is not None:
            shard.close()

    return write


class _Ranges:
    """Range reads from shards; the last few stay open."""

    def __init__(self):
        self.open: dict = {}

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            if len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            files, path = fs.FileSystem.from_uri(shard)
            self.open[shard] = files.open_input_file(path)
        data = self.open[shard].read_at(length, offset)
        if len(data) != length:
            raise EOFError(f"{shard} ends before {offset + length}")
        return data


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = _Ranges()
    for batch in batches:
        places = zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)
        found = [decode_header(ranges.read(s, o, HEADER_BYTES)) for s, o in places]
        extra = [pa.array([x[i] for x in found], pa.int32()) for i in range(4)]
        names = ["width", "height", "bit_depth", "color_type"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = _Ranges()
    kept = ["width", "height", "bit_depth", "shard", "offset"]
    for batch in batches:
        sizes, digests, tails, media_digests, features = [], [], [], [], []
        places = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True)
        for shard, offset, length, digest in places:
            media = ranges.read(shard, offset, length)
            own = hashlib.sha256(media).hexdigest()
            if own != digest:
                raise ValueError(f"{shard} at {offset} does not hold {digest}")
            payload = decode_png(media)
            sizes.append(len(payload))
            digests.append(hashlib.sha256(payload).hexdigest())
            tails.append(zlib.crc32(payload[-WIDTH:]))
            media_digests.append(own)
            features.append(feature(payload))
        columns = {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "payload_bytes": pa.array(sizes, pa.int64()),
            "payload_sha256": pa.array(digests, pa.string()),
            "tail_crc32": pa.array(tails, pa.int64()),
            "media_bytes": batch.column("length"),
            "media_sha256": pa.array(media_digests, pa.string()),
            "feature": pa.array(features, pa.string()),
        } | {c: batch.column(c) for c in kept}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def store(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store the padded texts; the table of addresses, written and read back."""
    write = _writer(scratch_path(docs.sparkSession, "media"), shard_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("h", F.xxhash64("data"))
    bucket = F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket")
    many = materialize(rows.groupBy("h").count().filter("count > 1").select(bucket).distinct(), "media-buckets")
    rows = rows.withColumn("bucket", bucket)
    once = rows.join(F.broadcast(many), "bucket", "left_anti").select("doc_id", "data")
    once = map_batches(once, write, ADDRESS)
    again = rows.join(F.broadcast(many), "bucket", "left_semi").withColumn("content", F.sha2("data", 256))
    contents = again.groupBy("content").agg(F.first("data").alias("data"))
    places = materialize(map_batches(contents, write, "content string, " + PLACE), "media-places")
    again = again.select("doc_id", "content").join(places.hint("merge"), "content").select(*once.columns)
    return materialize(once.unionByName(again), "media-rows")


def with_headers(addresses: DataFrame) -> DataFrame:
    """Adds width, height, bit depth and colour type, reading 33 bytes of each."""
    return map_batches(addresses, _headers, HEADER)


def with_contents(addressed: DataFrame) -> DataFrame:
    """Reads the media back: digests, checksum and feature of the payloads."""
    return map_batches(addressed, _contents, CONTENT)
