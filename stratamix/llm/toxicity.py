"""Toxicity by a sparse logistic classifier with a counterfactual penalty.

Features of a text: which words and word beginnings (4 to 6 letters) it has. Every labelled text is also read with
its identity terms swapped for others of the same kind, and without them; a text that names no group is read with a
term put in, with that term swapped, and as it is. The training loss adds the squared change of the score between
such readings, so a group's mere mention gains no weight, whether or not the labelled texts name it.
"""

from __future__ import annotations

import logging
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fresh, ship, table

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
#: Bounds of the training sample (labelled texts of each class) and of the features kept.
TEXTS_PER_CLASS, FEATURES = 3000, 4096
#: A feature is kept if its share differs between the classes by so many standard errors and it has so many texts.
LEAST_Z, LEAST_TEXTS = 4.0, 4
PENALTY, SPARSITY, STEPS = 2.0, 2e-4, 400

#: Terms that may stand for each other; a swap takes the next one of the row.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("mothers", "fathers"), ("wives", "husbands"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives", "refugees", "foreigners"), ("immigrant", "native", "refugee", "foreigner"), ("disabled", "deaf", "blind", "autistic"),
    ("elderly", "young"), ("africans", "europeans", "americans", "mexicans", "chinese", "indians"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("immigrés", "français"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "españoles"),
)
TERMS = tuple(w for row in IDENTITY for w in row)
SWAP = {a: b for row in IDENTITY for a, b in zip(row, (*row[1:], row[0]), strict=True)}


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    return [f"={word}", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


def counterfactuals(text: str | None, found: set[str]) -> list[tuple[set[str], set[str]]]:
    """Pairs of readings of a text with the words ``found`` that should score alike.

    The term that is put into a text without one is drawn by the text's checksum.
    """
    own = SWAP.keys() & found
    if not own:
        term = TERMS[zlib.crc32((text or "").encode()) % len(TERMS)]
        own, found = {term}, found | {term}
    return [(found, found - own | {SWAP[w] for w in own}), (found, found - own)]


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; what a word adds is remembered, for a bounded number of words."""

    MOST = 100_000

    def __init__(self, model: Classifier):
        self.weights, self.bias = model.weights, model.bias
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str | None) -> float:
        hit: set[str] = set()
        known, weights = self.known, self.weights
        for w in words(text):
            got = known.get(w)
            if got is None:
                got = tuple(f for f in features(w) if f in weights)
                if len(known) >= self.MOST:
                    known.clear()
                if len(w) <= 40:
                    known[w] = got
            if got:
                hit.update(got)
        z = self.bias + sum(weights[f] for f in sorted(hit))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: list[tuple[int, float, list[int]]], pairs: list[tuple[list[int], list[int]]], n: int) -> tuple[np.ndarray, float]:
    """Proximal gradient with momentum; rows: label, weight, features; pairs: the features of two readings that should score alike."""
    if not rows:
        return np.zeros(n), -20.0
    if not pairs:
        raise ValueError("no counterfactual readings to train with")
    logging.getLogger(__name__).info("training on %d texts and %d pairs of counterfactual readings", len(rows), len(pairs))
    y = np.array([r[0] for r in rows], float)
    weight = np.array([r[1] for r in rows], float)
    weight /= weight.sum()

    def matrix(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], int)

    r, c = matrix([x[2] for x in rows])
    # only what two readings don't share moves the change of the score
    pr, pc = matrix([sorted(set(p) - set(q)) for p, q in pairs])
    qr, qc = matrix([sorted(set(q) - set(p)) for p, q in pairs])
    w, b = np.zeros(n), 0.0
    u, ub, step_t = w.copy(), b, 1.0
    most = max([1, *np.bincount(r).tolist()]) if len(r) else 1
    apart = max([0, *(np.bincount(pr, minlength=len(pairs)) + np.bincount(qr, minlength=len(pairs))).tolist()])
    rate = 1 / ((1 + most) / 4 + 2 * PENALTY * apart)  # one over a bound of the curvature
    for _ in range(STEPS):
        z = np.bincount(r, u[c], len(y)) + ub
        d = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(c, d[r], n)
        gap = np.bincount(pr, u[pc], len(pairs)) - np.bincount(qr, u[qc], len(pairs))
        gap *= 2 * PENALTY / len(pairs)
        g += np.bincount(pc, gap[pr], n) - np.bincount(qc, gap[qr], n)
        new = u - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * SPARSITY, 0)
        new_b = ub - rate * d.sum()
        t = (1 + (1 + 4 * step_t**2) ** 0.5) / 2
        u, ub = new + (step_t - 1) / t * (new - w), new_b + (step_t - 1) / t * (new_b - b)
        w, b, step_t = new, new_b, t
    return w, b


def sample_labels(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic, weight) of at most about TEXTS_PER_CLASS ids of each class, drawn by a hash of the id.

    Null ids and labels don't count; an id with several labels is toxic if one of them is. Weights restore the
    classes' shares.
    """
    one = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("toxic")).dropna()
    one = one.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most two rows
    share = {y: min(1.0, TEXTS_PER_CLASS / max(1, n.get(y, 0))) for y in (0, 1)}
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = one.filter(unit < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    return drawn.withColumn("weight", F.when(F.col("toxic") == 1, 1 / share[1]).otherwise(1 / share[0]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Trains on a bounded sample of ``labels``; with no label of a class, or no text with a label, no text is told apart."""
    spark = docs.sparkSession
    ship(spark)
    drawn = sample_labels(labels, id_col=id_col, label_col=label_col).collect()  # about 2 * TEXTS_PER_CLASS short rows
    if not drawn:
        return Classifier({}, -20.0)
    named = spark.createDataFrame(drawn, "doc_id long, toxic int, weight double")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    texts = texts.join(F.broadcast(named), "doc_id").select("toxic", "weight", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for y, text in zip(b.column("toxic").to_pylist(), b.column("text"), strict=True):
                totals[y].update({f for w in words(text.as_py()) for f in features(w)})
                totals[y][""] += 1
        for y, c in totals.items():
            items = list(c.items())
            for k in range(0, len(items), 10_000):
                part = items[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(part), pa.int32()), pa.array([f for f, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["toxic", "feature", "n"])

    counts = texts.mapInArrow(counted, "toxic int, feature string, n long").groupBy("feature")
    counts = counts.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))
    n1, n0 = sum(r.toxic for r in drawn), sum(1 - r.toxic for r in drawn)
    if not n1 or not n0:
        return Classifier({}, 20.0 if n1 else -20.0)
    p = (F.col("n1") + F.col("n0") + 1) / (n1 + n0 + 2)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
    kept = counts.filter(F.col("feature") != "").withColumn("z", F.abs(z)).filter((F.col("z") >= LEAST_Z) & (F.col("n1") + F.col("n0") >= LEAST_TEXTS))
    names = [r.feature for r in kept.orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect()]
    names += sorted({f"={w}" for w in TERMS} - set(names))
    number = {f: i for i, f in enumerate(names)}

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = lambda found: sorted({number[f] for w in found for f in features(w) if f in number})
        for b in batches:
            own, readings = [], []
            for text in b.column("text"):
                found = words(text.as_py())
                own.append(pick(found))
                readings.append([pick(x) for pair in counterfactuals(text.as_py(), found) for x in pair])
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("weight"), pa.array(own, lists), pa.array(readings, pa.list_(lists))], names=["toxic", "weight", "own", "readings"])

    rows = sorted((tuple(r) for r in texts.mapInArrow(active, "toxic int, weight double, own array<int>, readings array<array<int>>").collect()), key=repr)
    pairs = [(x[k], x[k + 1]) for *_, x in rows for k in range(0, len(x), 2)]
    w, b = train([r[:3] for r in rows], pairs, len(names))
    return Classifier({f: float(x) for f, x in zip(names, w, strict=True) if x}, float(b))


def score(docs: DataFrame, model: Classifier, *, text_col: str = "text") -> DataFrame:
    """``docs`` with column ``score`` (0 to 1, higher: toxic label likelier), in place of one of that name.

    Null and empty texts get the score of a text without words. Whole texts count; repeated rows are scored
    each; an empty table gives no rows. Rows stay in their partition.
    """
    spark = docs.sparkSession
    ship(spark)
    if text_col not in docs.columns:
        raise ValueError(f"no column {text_col}")
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            scores = pa.array([scorer(t.as_py()) for t in b.column(text_col)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(run, ", ".join([*fields, "score double"]))


def labelled_fit(spark, sf_dir: str, docs: DataFrame) -> Classifier:
    """Labels of the rows that are not held out (crc32 of the id modulo 5 is not 0), texts of ``docs``."""
    labels = table(spark, sf_dir, "labels")
    return fit(docs, labels.filter(crc_mod("doc_id", 5) != 0))


def without_toxic(docs: DataFrame, model: Classifier, *, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more."""
    own = [c for c in docs.columns if c.lower() == "score"]
    name = fresh(docs.columns, "_own_score")
    scored = score(docs.withColumnsRenamed({c: name for c in own}), model, text_col=text_col).filter(F.col("score") < limit)
    return scored.drop("score").withColumnsRenamed({name: c for c in own}).select(*docs.columns)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, labelled_fit(spark, sf_dir, docs))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
