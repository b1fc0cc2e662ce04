"""Packing token streams into bounded sequences by an order-preserving dynamic programme.

A partition's documents, in ascending id, form one token stream. Windows of at most ``window`` tokens cover the
stream without gaps. Cuts are free at document ends, cheap at sentence ends and dearer inside a sentence; a
window pays one unit for each token of padding, none if it is full or its length is a power of two. The
cheapest windows come from

    best[j] = penalty[j] + window cost + min over i of best[i] + padding(pos[j] - pos[i]),   0 < pos[j] - pos[i] <= window

where padding is linear in pos, so a monotone queue over best[i] + pos[i] gives the minimum in amortised
constant time; the powers of two are separate transitions.

Partitions are packed apart, so the only padding that more partitions add is in the last window of each, and
that window is cut into powers of two where this is cheaper. No row leaves its partition: no shuffle.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, table
from .tokens import default_tokenizer, encoder, in_groups

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)

#: Penalties in tokens of padding.
SENTENCE_CUT, INNER_CUT = 1, 6
#: The same for each window, so that short windows are only made where they pay.
WINDOW_COST = 8
#: Tokens gathered before a stretch of the stream is solved; the last windows of a stretch are solved again with the next.
STRETCH = 1 << 18
#: Longest distance between possible cuts.
GAP = 128
#: Sequence ids of a partition begin at its number times this.
IDS_PER_PARTITION = 1 << 40


def best_cuts(ends: np.ndarray, kinds: np.ndarray, window: int, *, last: bool = True) -> list[int]:
    """Cut positions (the last of ``ends`` included) of the cheapest windows over the stream [0, ends[-1]).

    ``ends``: ascending positions where a cut is liked; ``kinds``: 0 for a document's end, 1 for a sentence's.
    Positions between them get the inner-cut penalty: one each ``GAP`` tokens, one a full window after each
    document's end, and, for the last stretch, those that split the rest into powers of two.
    """
    n = int(ends[-1])
    penalty = np.full(n + 1, -1, np.int32)
    penalty[GAP:n:GAP] = INNER_CUT
    full = ends[(kinds == 0) & (ends + window < n)] + window
    penalty[full] = INNER_CUT
    if window < n:
        penalty[window] = INNER_CUT
    if last:
        for bit in range(window.bit_length()):
            if (rest := n & ((1 << bit) - 1)) and n - rest > 0:
                penalty[n - rest] = INNER_CUT
    penalty[ends] = np.where(kinds == 0, 0, SENTENCE_CUT)
    penalty[n] = 0
    penalty[0] = 0
    at = np.flatnonzero(penalty >= 0)
    if (np.diff(at) > window).any():  # a window shorter than ``GAP``
        more = np.arange(window, n, window)
        penalty[more] = np.where(penalty[more] < 0, INNER_CUT, penalty[more])
        at = np.flatnonzero(penalty >= 0)
    penalty += WINDOW_COST
    node = np.full(n + 1, -1, np.int32)
    node[at] = np.arange(len(at), dtype=np.int32)
    befores, afters = [], []
    for bit in range(window.bit_length() - 1):
        head = at[np.searchsorted(at, 1 << bit) :]
        before = node[head - (1 << bit)]
        hit = np.flatnonzero(before >= 0)
        befores.append(before[hit])
        afters.append(node[head[hit]])
    after = np.concatenate(afters)
    exact = np.concatenate(befores)[np.argsort(after, kind="stable")].tolist()
    stops = np.cumsum(np.bincount(after, minlength=len(at))).tolist()  # of each node's windows of a power of two
    pos, pens = at.tolist(), penalty[at].tolist()
    best, came = [0] * len(pos), [0] * len(pos)
    # the monotone queue: its members' places, their values best + pos and their numbers, from ``first`` on
    places, values, numbers, first, e = [0], [0], [0], 0, 0
    for j in range(1, len(pos)):
        p = pos[j]
        low = p - window
        while places[first] < low:
            first += 1
        i = numbers[first]
        cost = values[first] - low
        stop = stops[j]
        while e < stop:
            k = exact[e]
            e += 1
            if best[k] < cost:
                cost, i = best[k], k
        cost += pens[j]
        best[j], came[j] = cost, i
        v = cost + p
        while len(values) > first and values[-1] >= v:
            values.pop()
            places.pop()
            numbers.pop()
        values.append(v)
        places.append(p)
        numbers.append(j)
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(pos[j])
        j = came[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of (doc_id, ids) into pieces of sequences; rows are as SCHEMA, ids are given beside them."""

    def __init__(self, window: int, first_sequence: int, sentence_end: np.ndarray):
        self.window, self.sequence, self.sentence_end = window, first_sequence, sentence_end
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens already placed, tokens in all
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, 0, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)
        return self._solve(last=False) if self.held >= STRETCH else []

    def finish(self) -> list[tuple]:
        return self._solve(last=True) if self.held else []

    def _solve(self, *, last: bool) -> list[tuple]:
        stream = np.concatenate(self.ids).astype("<u4")
        lengths = np.array([n - placed for _, placed, n in self.docs])
        doc_end = np.cumsum(lengths)
        kind = np.where(self.sentence_end[stream], 1, 2)
        kind[doc_end - 1] = 0
        liked = np.flatnonzero(kind < 2)
        cuts = best_cuts(liked + 1, kind[liked], self.window, last=last)
        if not last:  # what a later document could change stays
            cuts = [c for c in cuts if c <= len(stream) - 4 * self.window] or cuts[:1]
        rows, raw = [], stream.tobytes()
        d, begin = 0, 0
        starts = (doc_end - lengths).tolist()
        stops = doc_end.tolist()
        for cut in cuts:
            a = begin
            while a < cut:
                b = min(cut, stops[d])
                doc_id, placed, total = self.docs[d]
                rows.append((doc_id, placed + a - starts[d], b - a, zlib.crc32(raw[4 * a : 4 * b]), total, self.sequence, a - begin))
                a = b
                if b == stops[d]:
                    d += 1
            begin = cut
            self.sequence += 1
        kept = self.docs[d:]
        if kept:
            doc_id, placed, total = kept[0]
            kept[0] = (doc_id, placed + begin - starts[d], total)
        self.docs, self.ids, self.held = kept, [stream[begin:]] if kept else [], len(stream) - begin
        return rows


@functools.cache
def _sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its text ends a sentence; the separator id 0 counts only as a document's end."""
    tokenizer = encoder(path).tokenizer
    n = tokenizer.get_vocab_size(with_added_tokens=True)
    texts = tokenizer.decode_batch([[i] for i in range(n)], skip_special_tokens=False)
    return np.array([bool(t) and (t.rstrip(" ")[-1:] in ".!?…" and len(t.strip()) > 0 or "\n" in t) for t in texts])


def pack(docs: DataFrame, *, tokenizer: str | None = None, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence.

    Order: ascending id inside each partition of ``docs``, ties and null ids included (nulls first). Null and
    empty texts are documents of the end id alone. Repeated rows are packed each. Other columns are not read.
    An empty table gives no rows. ``sequence_id`` is unique over all partitions.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        packer = Packer(window, TaskContext.get().partitionId() * IDS_PER_PARTITION, _sentence_ends(path))
        end = np.array([end_id], dtype="<u4")
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=SCHEMA.names)

        for b in batches:
            for keys, texts in in_groups(b.column(0).to_pylist(), b.column(1)):
                for doc_id, ids in zip(keys, enc.encode_many(texts), strict=True):
                    out += packer.add(doc_id, np.concatenate([ids, end]))
                if len(out) >= 20_000:
                    yield batch()
                    out = []
        out += packer.finish()
        if out:
            yield batch()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.sortWithinPartitions("doc_id").mapInArrow(run, SCHEMA)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
