"""Document fingerprints: threshold-scaled sketches of the shingles of SHINGLE characters.

A sketch keeps every shingle hash below a fixed share of all hashes, so it grows with its document, and the sketch of a union
is the union of sketches. That allows estimates of how much of a short document stands in a very long one or in a whole
collection, which sketches of a fixed size cannot give. A text none of whose hashes is that small keeps its smallest one:
when sketches are merged it goes as soon as a smaller one is there, so merging stays exact.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

SHINGLE, SHARE = 16, 16
#: Hashes have 63 bits; those below are kept.
BOUND = (1 << 63) // SHARE
#: Buckets of neighbouring documents for each partition, so that a partition has several.
BUCKETS = 4
_BASE = 0xC2B2AE3D27D4EB4F


def _scattered(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``shingle`` characters, in order; a shorter text is one shingle, an empty one has none.

    A run's hash is a polynomial in its scattered characters, put together from runs half as long.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(chars):
        return np.zeros(0, np.int64)
    length = min(shingle, len(chars))
    half = _scattered(chars + np.uint64(1))
    out, done, size = None, 0, 1
    while True:
        if length & size:
            power = np.uint64(pow(_BASE, size, 1 << 64))
            out, done = (half, size) if out is None else (out[: len(chars) - done - size + 1] * power + half[done : done + len(chars) - done - size + 1], done + size)
        if 2 * size > length:
            break
        half = half[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + half[size:]
        size *= 2
    return (_scattered(out + np.uint64(length)) >> np.uint64(1)).view(np.int64)


def sketch(text: str) -> np.ndarray:
    """The kept hashes of a text, ascending."""
    h = shingle_hashes(text)
    kept = np.unique(h[h < BOUND])
    return kept if len(kept) or not len(h) else h.min(keepdims=True)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of common shingles among all of two texts; 1 for two empty texts.

    A hash that stands for a text without small ones is compared with its like only.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a[0] >= BOUND or b[0] >= BOUND:
        return float(len(a) == len(b) and a[0] == b[0])
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def as_string(hashes: np.ndarray) -> str:
    """Base 64 of the hashes, eight bytes each, the highest first."""
    return base64.b64encode(hashes.astype(">i8").tobytes()).decode()


def of_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">i8").astype(np.int64)


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, hashes) of each row; null texts count as empty, repeated rows and null ids stay. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sketch(t) for t in texts], pa.list_(pa.int64()))], names=["doc_id", "n_chars", "hashes"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, hashes array<long>")


def merged(sketched: DataFrame, *by: str) -> DataFrame:
    """(by, hash): the sketch of all rows of each group, a row a hash, so a group of any size is spread over tasks."""
    hashes = sketched.select(*by, F.explode("hashes").alias("hash"))
    small = hashes.filter(F.col("hash") < BOUND).distinct()
    # groups whose texts have no small hash at all
    least = hashes.groupBy(*by).agg(F.min("hash").alias("hash")).filter(F.col("hash") >= BOUND)
    return small.unionByName(least)


def containments(sketched: DataFrame, collections: DataFrame, *by: str) -> DataFrame:
    """(doc_id, by, contained): the estimated share of each document's shingles that stand in each collection, where it isn't 0.

    ``sketched`` has a row an id; ``collections`` comes from ``merged``. A document meets a collection once a common hash; the
    join is by hash, and a hash that very many documents share is left to Spark's splitting of skewed joins.
    """
    own = sketched.select("doc_id", F.size("hashes").alias("own"), F.explode("hashes").alias("hash"))
    met = own.join(collections.select(*by, "hash"), "hash").groupBy("doc_id", "own", *by).agg(F.count(F.lit(1)).alias("met"))
    return met.select("doc_id", *by, (F.col("met") / F.col("own")).alias("contained"))


def _below(values: list[int], x: Column, strict: bool) -> Column:
    """How many of ascending values lie below x (or at it, unless ``strict``), in two steps of a root of their number."""
    step = max(1, math.isqrt(len(values)))
    under = (lambda v: v < x) if strict else (lambda v: v <= x)
    count = lambda a: F.size(F.filter(a, under))
    longs = lambda vs: F.array(*[F.lit(v).cast("long") for v in vs]).cast("array<long>")
    before = F.greatest((count(longs(values[::step])) - 1) * step, F.lit(0))
    return before + count(F.slice(longs(values), before + 1, step))


def in_neighbourhoods(docs: DataFrame, n: int) -> DataFrame:
    """(bucket, guest, doc_id, h, text): each row in the bucket of its place by id, with the last row of the bucket before as its guest.

    Ids are cut at quantiles; a hot id, and rows without one, are cut by the texts' hashes, which follow the ids in the order.
    The bounds, and a row a bucket of ids and hashes, pass the driver; there are BUCKETS times as many as partitions.
    """
    keys = docs.select("doc_id", "h")
    most = BUCKETS * n
    cut = F.percentile_approx("doc_id", F.array(*[F.lit(i / most) for i in range(1, most)]), 100 * most) if most > 1 else F.array().cast("array<long>")
    total, known, quantiles = keys.agg(F.count(F.lit(1)), F.count("doc_id"), cut).first()
    quantiles = [int(q) for q in quantiles or []]
    without = math.ceil(most * (total - known) / total) if total else 0
    unit = (F.shiftright(F.col("h"), 11).cast("double") + float(1 << 52)) / float(1 << 53)  # in [0, 1), ascending with h
    low = _below(quantiles, F.col("doc_id"), True)
    same = _below(quantiles, F.col("doc_id"), False) - low
    at = F.when(F.col("doc_id").isNull(), F.floor(unit * without)).otherwise(without + low + F.floor(unit * same))
    placed = docs.withColumn("bucket", at.cast("int"))
    last = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("last")).orderBy("bucket").collect()  # a row a bucket
    rows = [(r.bucket, r.last.doc_id, r.last.h, last[(i + 1) % len(last)].bucket) for i, r in enumerate(last)]
    ends = docs.sparkSession.createDataFrame(rows, "bucket int, last_id long, last_h long, after int")
    placed = placed.join(F.broadcast(ends), "bucket")
    closes = F.col("doc_id").eqNullSafe(F.col("last_id")) & (F.col("h") == F.col("last_h"))
    here, there = F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("after").alias("bucket"), F.lit(True).alias("guest"))
    return placed.select(F.explode(F.when(closes, F.array(there, here)).otherwise(F.array(here))).alias("at"), "doc_id", "h", "text").select("at.*", "doc_id", "h", "text")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The next document is that of the next smaller id, after the smallest the largest; null ids are the smallest, and rows
    that repeat an id follow each other by a hash of their texts. The edited text has the last half of the characters, rounded
    down, replaced by as many of the next document's first ones, or all. Null texts count as empty; other columns are not read;
    no rows give none. Texts are shuffled once, to the places of their ids.
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, after_kept = "", None
        for b in batches:
            out = []
            for guest, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                kept = sketch(text)
                if not guest:
                    half = len(text) // 2
                    edited = text[: len(text) - half] + after[:half]
                    again = sketch(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((doc_id, len(text), sha, as_string(kept), as_string(again), likeness(kept, again), likeness(kept, after_kept)))
                after, after_kept = text, kept
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    placed = in_neighbourhoods(rows, n).repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("guest"), F.asc_nulls_first("doc_id"), "h")
    return placed.select("guest", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
