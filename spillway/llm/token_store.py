"""Token-ID output: sorted-string-table shards keyed by document identifier.

A shard is one immutable file in the shared folder:

    "SPSST001"
    data blocks      zstd(entries), then the crc32 of the raw block; about BLOCK raw bytes each
    index block      last key, offset and length of every data block
    Bloom filter     10 bits and 7 probes a key
    footer           fixed size: places of index and filter, counts, magic

An entry is (shared prefix length, suffix length, suffix, value length, value), all lengths as varints; a key is a
tag byte (0 null, 1 value), the identifier as 8 sign-flipped big-endian bytes, and a running number for equal
identifiers. A value is the document's ids, the end id included, as 16-bit integers, or 32-bit where one needs it.

Shards follow the identifier order: range partitioning, one shard a partition, written as a stream (a block at a
time), so a task's memory does not grow with its shard but for 20 bytes a key. A shard gets a name of its own for
every attempt; only those in the committed manifest are read, so a lost executor or a speculative copy leaves an
unread file behind, never a wrong result.

Cases: null text is empty (its ids are the end id alone); null identifiers come first; equal identifiers keep one
entry each, ordered by text; an empty table gives no shard and no rows; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._common import materialize, shared_path, small_batches
from ._tokens import encoder

MAGIC = b"SPSST001"
BLOCK = 1 << 16
FOOTER = struct.Struct("<QQQQQQ8s")
MANIFEST = "part int, path string, n_docs long, n_tokens long, first_key binary, last_key binary"


def key_of(doc_id: int | None, n: int) -> bytes:
    if doc_id is None:
        return b"\0" + bytes(8) + struct.pack(">I", n)
    return b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1)) + struct.pack(">I", n)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + k * b) % bits for k in range(7)]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Writes entries, given in key order, to one shard."""

    def __init__(self, sink):
        self.sink, self.at, self.raw, self.last = sink, 0, bytearray(), b""
        self.index, self.keys, self.n_tokens = [], [], 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _close_block(self) -> None:
        if self.raw:
            body = self.pack.compress(bytes(self.raw)) + struct.pack("<I", zlib.crc32(self.raw))
            self.index.append((self.last, self.at, len(body)))
            self._put(body)
            self.raw = bytearray()

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.raw:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        wide = np.frombuffer(ids, "<u4")
        value = b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\4" + ids
        self.raw += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value
        self.last = key
        self.keys.append(key)
        self.n_tokens += len(wide)
        if len(self.raw) >= BLOCK:
            self._close_block()

    def close(self) -> None:
        self._close_block()
        index_at = self.at
        for last, at, length in self.index:
            self._put(_varint(len(last)) + last + _varint(at) + _varint(length))
        bloom_at, bits = self.at, max(64, 10 * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key[:9], bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._put(bytes(bloom))
        self._put(FOOTER.pack(index_at, bloom_at, bits, len(self.index), len(self.keys), self.n_tokens, MAGIC))


class Reader:
    """Reads a shard by ranges: footer, index and filter once, then only the blocks that are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        f = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if f[6] != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.n_docs, self.n_tokens = f[2], f[4], f[5]
        raw = source.read_at(size - FOOTER.size - f[0], f[0])
        self.bloom, self.blocks, at = raw[f[1] - f[0] :], [], 0
        for _ in range(f[3]):
            n, at = _read_varint(raw, at)
            last, at = raw[at : at + n], at + n
            place, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.blocks.append((last, place, length))
        self.unpack = zstandard.ZstdDecompressor()

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, length = self.blocks[block]
        body = self.source.read_at(length, place)
        raw = self.unpack.decompress(body[:-4])
        if zlib.crc32(raw) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("damaged block")
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key, at = key[:shared] + raw[at : at + n], at + n
            n, at = _read_varint(raw, at)
            value, at = raw[at : at + n], at + n
            yield key, value[1:] if value[0] == 4 else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.blocks)):
            for key, ids in self._entries(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every entry with this identifier: filter, binary search of the index, then its blocks."""
        low = key_of(doc_id, 0)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(low[:9], self.bits)):
            return []
        found = []
        for k in range(bisect.bisect_left([b[0] for b in self.blocks], low), len(self.blocks)):
            for key, ids in self._entries(k):
                if key[:9] == low[:9]:
                    found.append(ids)
                elif key > low:
                    return found
        return found


def write_token_shards(docs: DataFrame, vocabulary: str, end_id: int = 0, label: str = "tokens") -> DataFrame:
    """Encode every text and write the shards; returns the committed manifest, one row a shard."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_path(spark, label)

    def write(batches):
        from pyspark import TaskContext

        part, tail = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        fs, base = open_fs(folder)
        writer = sink = first = None
        last_id, again = object(), 0
        name = f"{part:06d}-{uuid.uuid4().hex[:8]}.sst"
        encode = encoder(vocabulary).ids
        for batch in batches:
            ids = encode(batch.column("text").to_pylist())
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{base}/{name}")
                    writer = Writer(sink)
                again = again + 1 if doc_id == last_id else 0
                last_id, key = doc_id, key_of(doc_id, again)
                first = first or key
                writer.add(key, x + tail)
        if writer is not None:
            writer.close()
            sink.close()
            row = {"part": part, "path": name, "n_docs": len(writer.keys), "n_tokens": writer.n_tokens, "first_key": first, "last_key": writer.last}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())]))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), f"{label}-manifest")
    return manifest.withColumn("path", F.concat(F.lit(f"{folder}/"), "path"))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document, in shard order, from the files."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                fs, path = open_fs(shard["path"])
                rows, size, start = [], 0, shard["start"]
                with fs.open_input_file(path) as source:
                    for doc_id, ids in Reader(source).scan():
                        rows.append({"doc_id": doc_id, "start": start, "ids": ids})
                        start += len(ids) // 4
                        size += len(ids)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    # As many partitions as shards: a row is tiny beside the file it makes a task read, so sizes must not merge them.
    n = max(1, manifest.count())
    return shards.select("part", "path", "start").repartition(n, "part").mapInArrow(read, schema)


def token_digests(tokens: DataFrame) -> DataFrame:
    """The contract's columns, from the ids that were read back."""
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
