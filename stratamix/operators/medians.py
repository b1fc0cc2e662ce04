"""Halves of bins at exact medians, to any depth, for all bins at once: a k-d tree of cuts that is sent to all tasks.

A level of the tree takes one aggregation for the widest column of each piece and a few for its median: the values of a column are
counted in cells between two bounds, the cell that holds the middle gives the next bounds, and so on until they meet. Pieces that
a task can hold are left to it (see ``coreset``), so what passes the driver is a few numbers for each piece larger than that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How often a row counts.
TIMES = "_times"
#: Cells between the bounds of a median; a power of two.
CELLS = 2048


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


@dataclass
class Tree:
    """For each bin its depth and the place of its root; pieces are numbered like the nodes of a heap, from that place on.

    A node with a column has a cut: rows at or above it go to the second half. Rows stay in a node without.
    """

    bins: np.ndarray
    depth: np.ndarray
    first: np.ndarray
    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def of(cls, depths: dict[int, int]) -> Tree:
        bins = np.array(sorted(depths), np.int64)
        depth = np.array([depths[b] for b in bins], np.int64)
        size = np.int64(1) << (depth + 1)
        n = int(size.sum())
        return cls(bins, depth, np.cumsum(size) - size, np.full(n, -1, np.int16), np.zeros(n))

    def walk(self, bin_id: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each row's bin, the node that the row ends in, and that node's level."""
        at = np.searchsorted(self.bins, bin_id)
        node, level = np.ones(len(x), np.int64), np.zeros(len(x), np.int64)
        going = np.arange(len(x))
        while len(going):
            here = self.first[at[going]] + node[going]
            axis = self.axis[here]
            going, here, axis = going[axis >= 0], here[axis >= 0], axis[axis >= 0]
            node[going] = 2 * node[going] + (x[going, axis] >= self.cut[here])
            level[going] += 1
        return at, node, level


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bins, columns and TIMES of the rows."""
    for b in batches:
        if b.num_rows:
            yield b.column(0).to_numpy(zero_copy_only=False), np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:-1]], axis=1), b.columns[-1].to_numpy()


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as TIMES says, which is then 1 for the first of them and 0 for the others."""
    return rows.withColumn(TIMES, F.explode(F.sequence(F.lit(1).cast("long"), F.col(TIMES)))).withColumn(TIMES, (F.col(TIMES) == 1).cast("long"))


def _placed(rows: DataFrame, params: Sequence[str], tree, level: int) -> DataFrame:
    """(piece, params, TIMES) of the rows whose pieces reach ``level``, in bins that go deeper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for bin_id, x, times in _batches(batches):
            at, node, reached = t.walk(bin_id, x)
            on = (reached == level) & (t.depth[at] > level)
            yield pa.RecordBatch.from_arrays([pa.array((t.first[at] + node)[on]), *[pa.array(x[on, i]) for i in range(len(params))], pa.array(times[on])], names=["piece", *params, TIMES])

    return rows.select("bin_id", *params, TIMES).mapInArrow(run, ", ".join(["piece long", *[f"`{p}` double" for p in params], f"{TIMES} long"]))


@dataclass
class _Search:
    """The pieces of a level whose medians are looked for: column, bounds as ordered bits, rows below them, the two middle ranks."""

    piece: np.ndarray
    axis: np.ndarray
    low: np.ndarray
    high: np.ndarray
    below: np.ndarray
    rank: np.ndarray
    last: np.ndarray
    above: np.ndarray  # the least value above the bounds


def _cells(rows: DataFrame, params: Sequence[str], tree, search) -> DataFrame:
    """(piece, before, n, low, high, next): of each piece the cell that holds the middle, the rows in cells before it, its extremes, and the next value's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, s = tree.value, search.value
        for bin_id, x, times in _batches(batches):
            at, node, _ = t.walk(bin_id, x)
            piece = t.first[at] + node
            k = np.minimum(np.searchsorted(s.piece, piece), len(s.piece) - 1)
            v = x[np.arange(len(x)), s.axis[k]]
            bits = ordered_bits(v)
            on = (s.piece[k] == piece) & (bits >= s.low[k]) & (bits <= s.high[k]) & ~np.isnan(v)
            k, v, bits, times = k[on], v[on], bits[on], times[on]
            if not len(k):
                continue
            cell = ((bits - s.low[k]) >> shift[k]).astype(np.int64)
            order = np.lexsort((v, cell, k))
            k, v, cell, times = k[order], v[order], cell[order], times[order]
            begin = np.flatnonzero(np.r_[True, (np.diff(k) != 0) | (np.diff(cell) != 0)])
            end = np.r_[begin[1:], len(k)]
            yield pa.RecordBatch.from_arrays([pa.array(s.piece[k[begin]]), pa.array(cell[begin]), pa.array(np.add.reduceat(times, begin)), pa.array(v[begin]), pa.array(v[end - 1])], names=["piece", "cell", "n", "low", "high"])

    s = search.value
    width = (s.high - s.low) // np.uint64(CELLS) + np.uint64(1)
    shift = np.ceil(np.log2(width.astype(float))).astype(np.uint64)
    shift += (np.uint64(1) << shift) < width  # the logarithm of a large width is rounded
    parts = rows.select("bin_id", *params, TIMES).mapInArrow(run, "piece long, cell long, n long, low double, high double")
    whole = parts.groupBy("piece", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    w = W.partitionBy("piece").orderBy("cell")  # at most CELLS rows and one
    whole = whole.withColumns({"before": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), "next": F.lead("low").over(w)})
    wanted = rows.sparkSession.createDataFrame(list(zip(s.piece.tolist(), (s.rank - s.below).tolist(), strict=True)), "piece long, at long")
    whole = whole.withColumn("before", F.coalesce("before", F.lit(0).cast("long"))).join(F.broadcast(wanted), "piece")
    return whole.filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("n"))).drop("at", "cell")


def _medians(rows: DataFrame, params: Sequence[str], tree, search: _Search) -> dict[int, float]:
    """The exact medians: the mean of the two middle values of an even number."""
    found: dict[int, float] = {}
    sc = rows.sparkSession.sparkContext
    while len(search.piece):
        sent = sc.broadcast(search)
        got = _cells(rows, params, tree, sent).toPandas().set_index("piece").loc[search.piece]  # a row a piece
        sent.destroy()
        low, high, after = (got[c].to_numpy(float) for c in ("low", "high", "next"))
        after = np.where(np.isnan(after), search.above, after)
        before, n = search.below + got["before"].to_numpy(), got["n"].to_numpy()
        done = low == high
        for i in np.flatnonzero(done):
            # the upper middle value is the next one if the lower one's rows end before it
            found[int(search.piece[i])] = float(low[i]) if search.last[i] < before[i] + n[i] else float((low[i] + after[i]) / 2)
        go = ~done
        search = _Search(search.piece[go], search.axis[go], ordered_bits(low[go]), ordered_bits(high[go]), before[go], search.rank[go], search.last[go], after[go])
    return found


def median_tree(rows: DataFrame, params: Sequence[str], depths: dict[int, int], held: int) -> Tree:
    """The cuts of bins at the exact medians of their pieces' widest columns, level by level: those of pieces of more than ``held`` rows.

    ``rows``: bin_id, the columns, and in TIMES how often the row counts; one if there is no such column. ``held`` bounds rows as they stand. No piece is cut deeper than ``depths`` says for its bin; of columns that are equally wide
    the first counts.
    Nulls and NaN have no part in widths and medians and lie below every cut.
    """
    tree = Tree.of(depths)
    rows = rows if TIMES in rows.columns else rows.withColumn(TIMES, F.lit(1).cast("long"))
    sc = rows.sparkSession.sparkContext
    for level in range(int(tree.depth.max(initial=0))):
        sent = sc.broadcast(tree)
        known = lambda p: F.nanvl(F.col(f"`{p}`"), F.lit(None).cast("double"))
        widths = [f(known(p)).alias(f"{n}{i}") for i, p in enumerate(params) for n, f in (("n", F.count), ("w", F.stddev_pop), ("l", F.min), ("h", F.max))]
        found = repeated(_placed(rows, params, sent, level)).groupBy("piece").agg(F.sum(TIMES).alias("rows"), *widths).filter(F.col("rows") > max(held, 1)).orderBy("piece").toPandas()  # a row a piece
        found = found[found[[f"n{i}" for i in range(len(params))]].max(axis=1) > 0]
        if not len(found):
            break
        of = lambda c: found[[f"{c}{i}" for i in range(len(params))]].to_numpy(float)  # noqa: B023, E731
        axis = np.nan_to_num(of("w"), nan=-1.0).argmax(axis=1)
        pick = lambda c: of(c)[np.arange(len(found)), axis]  # noqa: B023, E731
        n = pick("n").astype(np.int64)
        search = _Search(found["piece"].to_numpy(), axis, ordered_bits(pick("l")), ordered_bits(pick("h")), np.zeros(len(n), np.int64), (n - 1) // 2, n // 2, pick("h"))
        cuts = _medians(rows, params, sent, search)
        tree.axis[found["piece"].to_numpy()] = axis
        for piece, cut in cuts.items():
            tree.cut[piece] = cut
        sent.destroy()
    return tree


def with_pieces(rows: DataFrame, params: Sequence[str], tree: Tree) -> DataFrame:
    """(bin_id, path, todo, params, TIMES): the piece that each row falls into, numbered among those of its level, and the levels that are left."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for bin_id, x, times in _batches(batches):
            at, node, level = t.walk(bin_id, x)
            yield pa.RecordBatch.from_arrays([pa.array(bin_id, pa.int32()), pa.array(node - (1 << level)), pa.array((t.depth[at] - level).astype(np.int32)), *[pa.array(x[:, i]) for i in range(len(params))], pa.array(times)], names=["bin_id", "path", "todo", *params, TIMES])

    return rows.select("bin_id", *params, TIMES).mapInArrow(run, ", ".join(["bin_id int, path long, todo int", *[f"`{p}` double" for p in params], f"{TIMES} long"]))


def _median(v: np.ndarray, times: np.ndarray) -> float:
    """The exact median of values, each so many times; NaN don't count."""
    known = ~np.isnan(v)
    order = np.argsort(v[known], kind="stable")
    v, upto = v[known][order], np.cumsum(times[known][order])
    low, high = np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], side="right")
    return v[low] if low == high else (v[low] + v[high]) / 2


def halves(x: np.ndarray, depth: int, times: np.ndarray | None = None) -> np.ndarray:
    """The same cuts for rows that a task holds: each row's number among the pieces of that depth. A single row counts as below its median.

    ``times``: how often each row counts.
    """
    label = np.zeros(len(x), np.int64)
    times = np.ones(len(x), np.int64) if times is None else times
    for _ in range(depth):
        order = np.argsort(label, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
        new = 2 * label
        for at in np.split(order, begin[1:]):
            part, often = x[at], times[at]
            if often.sum() < 2:
                continue
            known = ~np.isnan(part)
            n = np.maximum(often @ known, 1)
            mean = often @ np.where(known, part, 0.0) / n
            wide = np.where(known.any(axis=0), often @ np.where(known, part - mean, 0.0) ** 2 / n, -1.0)
            v = part[:, wide.argmax()]
            if not np.isnan(v).all():
                new[at] += v >= _median(v, often)
        label = new
    return label
