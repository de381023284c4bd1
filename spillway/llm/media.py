"""Media columns: content-addressed payloads in tar shards, with rows that carry digest, shard, offset and length.

A text's payload is its UTF-8 bytes, padded with zero bytes to a positive multiple of 64. It is stored without loss as
a grey image of 8-bit samples, 64 wide (PNG, no row filter), in a tar shard under the sha256 of the payload. Addresses
hold over all shards: of equal payloads the document with the least identifier is stored, by the task that reads it, and
all of their rows point at that copy. Texts stay in place: a row learns whether it is stored from a table of the digests
that occur more than once, which is broadcast if it is small enough. A shard's name is new for every attempt and only
rows of committed attempts name it, so lost executors leave nothing that is read.

Reading: the header columns (width, height, bits) take one ranged read of the first 33 bytes; features take one more
of the body. Each stored object is read and decoded once and its columns are joined to its rows by digest; the digests
of very many rows are few and take a broadcast of their own, so no task gathers the rows of a hot payload.

Cases: null text is empty (64 zero bytes); equal texts have equal values; null and repeated identifiers keep their
rows; equal payloads under one identifier, or all without any, may be stored more than once, and their rows point at one
of the copies; an empty table writes nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, shared_path, small_batches
from .token_store import open_fs

UNIT = 64
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
#: Bytes of the table of repeated digests that may be broadcast, at 64 a row; beyond, that join shuffles the texts.
BROADCAST_BYTES = 48 << 20
#: A digest is hot if it has more than this part of all rows, so at most as many are hot.
HOT = 1000
OBJECTS = "digest string, shard string, offset long, length long"
PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def image_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER_BYTES bytes."""
    if head[:8] != PNG or head[12:16] != b"IHDR":
        raise ValueError("not a stored image")
    return struct.unpack(">IIB", head[16:25])


def decode_image(stored: bytes) -> bytes:
    width, height, _ = image_header(stored)
    at, data = 8, []
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            data.append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Integer features of the samples: sum, least, greatest, distinct, and a histogram of eight equal ranges."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    used = np.flatnonzero(counts)
    ranges = ",".join(map(str, counts.reshape(8, 32).sum(axis=1)))
    return f"rows={len(x) // UNIT};sum={int(counts @ np.arange(256))};min={used[0]};max={used[-1]};distinct={len(used)};hist={ranges}"


def _tar_header(name: str, size: int) -> bytes:
    h = bytearray(512)
    h[: len(name)] = name.encode()
    h[100:108], h[108:116], h[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    h[124:136], h[136:148], h[148:156] = b"%011o\0" % size, b"00000000000\0", b" " * 8
    h[156:157], h[257:265] = b"0", b"ustar\x0000"
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


class _Shard:
    def __init__(self, folder: str):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tar"
        self.sink, self.at, self.kept = fs.open_output_stream(f"{base}/{self.name}"), 0, {}

    def put(self, digest: str, payload: bytes) -> tuple[int, int]:
        if digest not in self.kept:
            stored = encode_image(payload)
            self.sink.write(_tar_header(f"{digest}.png", len(stored)))
            self.sink.write(stored + bytes(-len(stored) % 512))
            self.kept[digest] = (self.at + 512, len(stored))
            self.at += 512 + len(stored) + -len(stored) % 512
        return self.kept[digest]

    def close(self) -> None:
        self.sink.write(bytes(1024))
        self.sink.close()


def _attached(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """rows with the columns of their digest's row of objects, where each digest occurs once."""
    n = rows.count()
    hot = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n / HOT).select("digest", F.lit(True).alias("_hot"))  # fewer than HOT rows
    tagged = rows.join(F.broadcast(hot), "digest", "left")
    few = F.broadcast(objects.join(F.broadcast(hot), "digest", "left_semi"))
    warm = tagged.filter("_hot").drop("_hot").join(few, "digest")
    cold = tagged.filter("_hot is null").drop("_hot").join(objects, "digest")
    return warm.unionByName(cold)


def store(docs: DataFrame, label: str = "media") -> DataFrame:
    """Write the shards; a row per document with digest, shard (full path), offset and length."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_path(spark, label)
    schema = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches):
        shard = None
        for batch in batches:
            rows = []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                payload, _ = payload_of(text)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError("a payload does not match its digest")
                if shard is None or shard.at > SHARD_BYTES and digest not in shard.kept:
                    if shard is not None:
                        shard.close()
                    shard = _Shard(folder)
                offset, length = shard.put(digest, payload)
                rows.append((digest, shard.name, offset, length))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if shard is not None:
            shard.close()

    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("raw"))
    padded = F.expr(f"rpad(raw, cast(greatest({UNIT}, ceil(n_bytes / {UNIT}) * {UNIT}) AS int), X'00')")
    texts = texts.withColumn("digest", F.sha2(padded, 256))
    rows = materialize(texts.select("doc_id", "n_bytes", "digest"), f"{label}-digests")
    least = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_least"))
    again = materialize(least.filter("_n > 1").select(F.unhex("digest").alias("_digest"), "_least"), f"{label}-repeated")
    if again.count() * 64 <= BROADCAST_BYTES:
        again = F.broadcast(again)
    ours = texts.select("doc_id", "digest", "text").join(again, F.unhex("digest") == F.col("_digest"), "left")
    ours = ours.filter(F.col("_digest").isNull() | F.col("doc_id").eqNullSafe(F.col("_least")))
    stored = materialize(ours.select("digest", "text").mapInArrow(write, OBJECTS), f"{label}-objects")
    place = F.min(F.struct(F.concat(F.lit(f"{folder}/"), "shard").alias("shard"), "offset", "length")).alias("place")
    return materialize(_attached(rows, stored.groupBy("digest").agg(place).select("digest", "place.*")), f"{label}-rows")


def _read_objects(batches, schema, fields):
    """Open each shard once; objects come sorted by shard and offset."""
    open_shard = source = None
    for batch in batches:
        cols: list[list] = [[] for _ in schema]
        for row in batch.to_pylist():
            if row["shard"] != open_shard:
                if source is not None:
                    source.close()
                fs, path = open_fs(row["shard"])
                open_shard, source = row["shard"], fs.open_input_file(path)
            for col, x in zip(cols, (row["digest"], *fields(source, row)), strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
    if source is not None:
        source.close()


def _read(rows: DataFrame, fields, names: str) -> DataFrame:
    """digest and the named columns of each stored object of rows. As many partitions as shards: an object's row is tiny
    beside what it makes a task read, so sizes must not merge them."""
    names = f"digest string, {names}"
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))])
    objects = rows.select("digest", "shard", "offset", "length").distinct()
    n = rows.select("shard").distinct().count()
    ordered = objects.repartition(max(1, n), "shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(lambda b: _read_objects(b, schema, fields), names)


def header_columns(rows: DataFrame) -> DataFrame:
    """doc_id, digest and width, height and bits of each row's object, from ranged reads of the header alone."""

    def fields(source, row):
        return image_header(source.read_at(HEADER_BYTES, row["offset"]))

    read = materialize(_read(rows, fields, "width long, height long, bits int"), "media-headers")
    return _attached(rows.select("doc_id", "digest"), read).select("doc_id", "digest", "width", "height", "bits")


def feature_columns(rows: DataFrame) -> DataFrame:
    """What the stored bytes give when read back: header columns, digests of payload and stored form, features."""
    names = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"

    def fields(source, row):
        width, height, _ = image_header(source.read_at(HEADER_BYTES, row["offset"]))
        stored = source.read_at(row["length"], row["offset"])
        payload = decode_image(stored)
        digest = hashlib.sha256(payload).hexdigest()
        if digest != row["digest"]:
            raise ValueError("a stored object does not match its digest")
        return len(payload), digest, zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload), width, height

    read = materialize(_read(rows, fields, names), "media-features")
    return _attached(rows.select("doc_id", "n_bytes", "digest"), read).select("doc_id", "n_bytes", *[x.split()[0] for x in names.split(", ")])
