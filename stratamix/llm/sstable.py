"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order:

    blocks   zstd-compressed; entries are  shared(varint) rest(varint) size(varint) key-suffix ids, where the key
             shares its first bytes with the one before; every RESTART-th entry has its whole key
    filter   Bloom bits over the keys
    index    for each block: first key, last key, offset, stored size, raw size, crc32 of the stored bytes
    footer   64 bytes: offsets and sizes of filter and index, counts, id width, version, magic

Lookup reads the footer, filter and index, searches the index by bisection and reads the blocks that can hold
the key. Key of an id: one byte, 0 for null and 1 otherwise, then the id as big-endian with its sign flipped,
so byte order is id order with nulls first.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, ship, table
from .tokens import default_tokenizer, encoder, in_groups

MAGIC, VERSION = b"SSTTOKEN", 1
FOOTER = struct.Struct("<QQQQQQBBH4x8s")
INDEX = struct.Struct("<HHQIII")
BLOCK_BYTES, RESTART = 64 << 10, 16
#: A shard is closed, and the next one begun, at so many stored bytes or keys: a writer's memory is bounded whatever a task gets.
SHARD_BYTES, SHARD_KEYS = 512 << 20, 1 << 20
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class Writer:
    """Writes one shard to an open stream; keys must come in ascending order, equal keys are kept each."""

    def __init__(self, stream, dtype: np.dtype):
        self.stream, self.dtype, self.at = stream, np.dtype(dtype), 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self.tokens = 0
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.entries, self.first, self.last = bytearray(), 0, b"", b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries % RESTART:
            limit = min(len(key), len(self.last))
            while shared < limit and key[shared] == self.last[shared]:
                shared += 1
        if not self.entries:
            self.first = key
        raw = np.asarray(ids, self.dtype).tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(raw)) + key[shared:] + raw
        self.last, self.entries = key, self.entries + 1
        self.keys.append(key)
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.entries:
            return
        stored = pa.compress(bytes(self.block), codec="zstd", asbytes=True)
        self.stream.write(stored)
        self.index.append(INDEX.pack(len(self.first), len(self.last), self.at, len(stored), len(self.block), zlib.crc32(stored)) + self.first + self.last)
        self.at += len(stored)
        self._new_block()

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        flags = np.zeros(bits, bool)
        for k in self.keys:
            flags[_probes(k, bits)] = True
        bloom = np.packbits(flags, bitorder="little").tobytes()
        index = b"".join(self.index)
        self.stream.write(bloom)
        self.stream.write(index)
        self.stream.write(FOOTER.pack(self.at, bits, self.at + len(bloom), len(index), len(self.keys), self.tokens, self.dtype.itemsize, VERSION, 0, MAGIC))


class Table:
    """Reads one shard from an open random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        bloom_at, self.bits, index_at, index_size, self.entries, self.tokens, width, version, _, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        self.dtype = np.dtype(f"<u{width}")
        file.seek(bloom_at)
        self.bloom = file.read(index_at - bloom_at)
        raw, at = file.read(index_size), 0
        self.blocks: list[tuple[bytes, bytes, int, int, int, int]] = []
        while at < len(raw):
            a, b, *rest = INDEX.unpack_from(raw, at)
            at += INDEX.size
            self.blocks.append((raw[at : at + a], raw[at + a : at + a + b], *rest))
            at += a + b
        self.lasts = [x[1] for x in self.blocks]

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, np.ndarray]]:
        _, _, offset, stored, size, crc = block
        self.file.seek(offset)
        data = self.file.read(stored)
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
        at, key = 0, b""
        while at < size:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, self.dtype, n // self.dtype.itemsize, at)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in self.blocks:
            yield from self._entries(block)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The id arrays of all entries with this key."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        found = []
        for block in self.blocks[bisect.bisect_left(self.lasts, key) :]:
            if block[0] > key:
                break
            found += [ids for k, ids in self._entries(block) if k == key]
        return found


def write_shards(docs: DataFrame, *, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None, shard_bytes: int = SHARD_BYTES, shard_keys: int = SHARD_KEYS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes ``docs`` as shards of disjoint ascending key ranges; returns the manifest and the folder.

    ``shards`` is the number of writing tasks, which begin a new file at ``shard_bytes`` or ``shard_keys``. Null and empty
    texts are the end id alone. Repeated ids are kept each; a null id sorts first. Other columns are not read. A task writes under a name of its own, and only names in the manifest, which Spark commits,
    are ever read: a lost or repeated task leaves at most a file that nothing names.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    folder = folder or shared_dir(spark, "shards")
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rolled = TaskContext.get().partitionId(), 0
        out = stream = first = last = name = None
        enc, end = encoder(path), np.array([end_id], "<u4")

        def closed() -> pa.RecordBatch:
            out.close()
            stream.close()
            row = {"shard": task * ROLLED + rolled, "path": name, "first_key": first, "last_key": last, "entries": len(out.keys), "tokens": out.tokens}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for b in batches:
            for keys, texts in in_groups(b.column(0).to_pylist(), b.column(1)):
                for doc_id, ids in zip(keys, enc.encode_many(texts), strict=True):
                    if out is not None and (out.at >= shard_bytes or len(out.keys) >= shard_keys):
                        yield closed()
                        out, rolled = None, rolled + 1
                    key = key_of(doc_id)
                    if out is None:
                        name = f"{folder}/{task:06d}-{rolled:06d}-{uuid.uuid4().hex}.sst"
                        fs, where = pafs.FileSystem.from_uri(name)
                        stream = fs.open_output_stream(where)
                        out, first = Writer(stream, enc.dtype), key
                    out.add(last := key, np.concatenate([ids, end]))
        if out is not None:
            yield closed()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    manifest = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"), folder


#: Shard numbers of a task begin at its number times this.
ROLLED = 1 << 20
MANIFEST = T.StructType([T.StructField("shard", T.LongType()), T.StructField("path", T.StringType()), T.StructField("first_key", T.BinaryType()), T.StructField("last_key", T.BinaryType()), T.StructField("entries", T.LongType()), T.StructField("tokens", T.LongType())])
_ARROW = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("entries", pa.int64()), ("tokens", pa.int64())])
DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_digests(manifest: DataFrame) -> DataFrame:
    """One row per stored document: its id, the ids before it over all shards, its count and the ids' crc32.

    The manifest has a short row per shard, of about SHARD_BYTES each where there is much data, so it may pass the driver.
    """
    spark = manifest.sparkSession
    ship(spark)
    listed = sorted(manifest.select("shard", "path", "first_key", "tokens").collect(), key=lambda r: (bytes(r.first_key), r.shard))
    rows, base = [], 0
    for r in listed:
        rows.append((r.path, base))
        base += r.tokens
    if not rows:
        return spark.createDataFrame([], DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, where = pafs.FileSystem.from_uri(row["path"])
                start, out = row["base"], []
                with fs.open_input_file(where) as file:
                    for key, ids in Table(file):
                        out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=DIGEST.names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=DIGEST.names)

    named = spark.createDataFrame(rows, "path string, base long")
    return named.repartition(len(rows), F.col("path")).mapInArrow(run, DIGEST)


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The id arrays stored for one id: the manifest picks shards by key range, each answers by binary search."""
    key = key_of(doc_id)
    found = []
    for r in manifest.filter((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).select("path").collect():
        fs, where = pafs.FileSystem.from_uri(r.path)
        with fs.open_input_file(where) as file:
            found += [ids.copy() for ids in Table(file).get(key)]
    return found


def op6_sstable(spark, sf_dir: str) -> DataFrame:
    manifest, _ = write_shards(table(spark, sf_dir, "documents"))
    return read_digests(manifest)
