"""Nearest neighbours by largest inner product with a hash-prefix forest.

Every vector has one long bit string per tree, from hyperplanes drawn once and balanced on a bounded sample. A
shard of the index holds, for each tree, its strings in a sorted array. A query descends each tree to its longest
prefix match by bisection, then all trees ascend together, one bit at a time, until the ranges of vectors that
share the query's prefix hold enough candidates; those are scored by their original vectors in double precision.

How many candidates are enough is measured at fit time: brute force on the sample gives the share of a shard
that the trees must reach for RECALL. Vectors of one length compare by angle; for others one coordinate is added
that makes all lengths equal and leaves inner products as they are.

The index is dealt once to tasks, a bounded number of vectors each, and cut into shards there. The queries are not
shuffled: each task reads them from the shared folder in blocks of bounded size, and gives back its best k + 1 for each.
Equal vectors share one entry: of them, only the k + 1 smallest ids can ever be in an answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, table, written

TREES, BITS = 10, 32
RECALL, SAMPLE, SAMPLE_QUERIES = 0.96, 4096, 96
#: Bounds of a shard, of a block of queries, and about those of the vectors that a task gets.
SHARD, BLOCK, DEALT = 4096, 4096, 1 << 16


@dataclass
class Forest:
    """What a task needs to build and search a shard."""

    planes: np.ndarray  # (dim + 1, TREES * BITS)
    offsets: np.ndarray
    norm: float
    share: float

    def strings(self, x: np.ndarray, *, query: bool) -> np.ndarray:
        """(TREES, n) bit strings as integers whose order is the strings' order."""
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        bits = np.concatenate([x, extra[:, None]], axis=1) @ self.planes > self.offsets
        weights = (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
        return np.stack([bits[:, t * BITS : (t + 1) * BITS].astype(np.uint64) @ weights for t in range(TREES)])

    def index(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree, the order of a shard's vectors by their strings, and the strings in that order."""
        own = self.strings(x, query=False)
        order = np.argsort(own, axis=1, kind="stable")
        return order, np.take_along_axis(own, order, axis=1)

    def search(self, index: tuple[np.ndarray, np.ndarray], asked: np.ndarray, share: float | None = None) -> Iterator[np.ndarray]:
        """For each query, given as its strings, the numbers of its candidates in a shard."""
        order, ordered = index
        n, queries = order.shape[1], asked.shape[1]
        enough = int(np.ceil((share if share is not None else self.share) * n))
        low, high = np.zeros((TREES, queries), int), np.full((TREES, queries), n)
        open_ = np.ones(queries, bool)
        for level in range(BITS, -1, -1):
            rest = np.uint64((1 << (BITS - level)) - 1)
            at = np.flatnonzero(open_)
            a = np.stack([np.searchsorted(ordered[t], asked[t, at] & ~rest) for t in range(TREES)])
            b = np.stack([np.searchsorted(ordered[t], asked[t, at] | rest, side="right") for t in range(TREES)])
            low[:, at], high[:, at] = a, b
            # distinct candidates: together at least as many as the largest range, at most the sum
            least = (b - a).max(axis=0) >= enough
            maybe = np.flatnonzero(~least & ((b - a).sum(axis=0) >= enough))
            for i in maybe:
                least[i] = len(np.unique(np.concatenate([order[t, a[t, i] : b[t, i]] for t in range(TREES)]))) >= enough
            open_[at[least]] = False
            if not open_.any():
                break
        for i in range(queries):
            hit = np.zeros(n, bool)
            for t in range(TREES):
                hit[order[t, low[t, i] : high[t, i]]] = True
            yield np.flatnonzero(hit)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best: highest score first, ties to the smaller id."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def fit(vectors: DataFrame, k: int, seed: int = 11) -> Forest | None:
    """From (vec_id, v): planes for the vectors' dimension, offsets at the sample's medians, the share that RECALL takes."""
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    if not stats.n:
        return None
    unit = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = vectors.filter(unit < min(1.0, 1.2 * SAMPLE / stats.n)).limit(2 * SAMPLE).collect()
    x = np.array([r.v for r in rows] or [r.v for r in vectors.limit(1).collect()], float)
    r = np.random.default_rng(seed)
    forest = Forest(r.normal(size=(x.shape[1] + 1, TREES * BITS)), np.zeros(TREES * BITS), float(stats.norm) * (1 + 1e-12), 1.0)
    extra = np.sqrt(np.maximum(forest.norm**2 - (x * x).sum(axis=1), 0))
    forest.offsets = np.median(np.concatenate([x, extra[:, None]], axis=1) @ forest.planes, axis=0)
    asked = x[:SAMPLE_QUERIES]
    if len(x) > 4 * k:
        scores = asked @ x.T
        scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        truth = np.argsort(-scores, axis=1)[:, :k]
        index, strings = forest.index(x), forest.strings(asked, query=True)
        for share in np.arange(0.02, 1.0, 0.02):
            if np.mean([np.isin(t, c).mean() for t, c in zip(truth, forest.search(index, strings, share), strict=True)]) >= RECALL:
                forest.share = float(share)
                break
    return forest


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors ``v`` of a batch, which all have one dimension."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _blocks(files: list[str]) -> Iterator[pa.RecordBatch]:
    for path in files:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as file:
            yield from pq.ParquetFile(file).iter_batches(BLOCK)


def nearest(table_: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every``, the k best others found, ranks from 1.

    Null, empty and zero vectors, those with a null or non-finite component, and those of another dimension than
    most (the larger at a tie) take no part; nor do rows with a null id. Repeated rows of one id and vector count
    once. An empty table gives no rows.
    """
    spark = table_.sparkSession
    ship(spark)
    rows = table_.select(table_[id_col].cast("long").alias("vec_id"), table_[vector_col].cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == dims.dim).withColumns({"c1": F.xxhash64("v"), "c2": F.xxhash64(F.lit(5), "v")})
    first = F.row_number().over(W.partitionBy("c1", "c2").orderBy("vec_id"))
    entries = written(rows.dropDuplicates(["vec_id", "c1", "c2"]).withColumn("_n", first).filter(F.col("_n") <= k + 1).drop("_n"), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0)
    classes = written(asked.groupBy("c1", "c2").agg(F.first("v").alias("v")), "queries")
    forest = spark.sparkContext.broadcast(fit(entries.select("vec_id", "v"), k))
    dealt = entries.count()
    files = classes.inputFiles()
    if not files:
        return spark.createDataFrame([], schema)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("vec_id").to_numpy(), matrix(b)) for b in batches if b.num_rows]
        if not held:
            return
        ids, x = (np.concatenate(part) for part in zip(*held, strict=True))
        starts = range(0, len(x), SHARD)
        indexes = [forest.value.index(x[at : at + SHARD]) for at in starts]
        longest = float(np.sqrt((x * x).sum(axis=1).max()))
        for block in _blocks(files):
            q, c1, c2 = matrix(block), block.column("c1").to_numpy(), block.column("c2").to_numpy()
            asked = forest.value.strings(q, query=True)
            hits: list[list[np.ndarray]] = [[] for _ in q]
            for at, index in zip(starts, indexes, strict=True):
                for i, found in enumerate(forest.value.search(index, asked)):
                    near = x[at + found] @ q[i]
                    if len(near) > k + 1:  # what rounding cannot have moved out of the best; the matrix product rounds by place
                        least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                        found = found[near >= least - 1e-9 * (abs(least) + longest * np.sqrt(q[i] @ q[i]))]
                    hits[i].append(at + found)
            out = []
            for i, found in enumerate(map(np.concatenate, hits)):
                scores = (x[found] * q[i]).sum(axis=1)  # one order of addition for all pairs, so equal vectors tie
                out += [(int(c1[i]), int(c2[i]), int(ids[found[j]]), float(scores[j])) for j in _best(ids[found], scores, k + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["c1", "c2", "vec_id", "score"])

    tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-dealt // SHARD)), -(-dealt // DEALT))
    found = entries.select("vec_id", "v").repartition(tasks, "vec_id").mapInArrow(searched, "c1 long, c2 long, vec_id long, score double")
    order = W.partitionBy("c1", "c2").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n")
    own = asked.select(F.col("vec_id").alias("query_id"), "c1", "c2").distinct()
    out = own.join(best, ["c1", "c2"]).filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
