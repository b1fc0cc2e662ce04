"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of fixed length, the last one padded. In a window, filters of
several widths run over the bytes' embeddings, max pooling keeps each filter's strongest answer, and a softmax
layer gives the languages' probabilities. A text's log-probabilities are the means over its windows, weighted
by their bytes. The network is trained here in numpy on windows of labelled texts.

For prediction the first layer is folded into tables over byte pairs, so a window costs two table reads a byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fresh, sent_if_small, ship, table

WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8
WINDOW = 256
#: Bounds of the training sample: texts for each language and in all, and windows for each text.
TEXTS_PER_LANGUAGE, TEXTS, WINDOWS_PER_TEXT = 800, 240_000, 4
EPOCHS, BATCH, RATE = 6, 64, 4e-3
UNKNOWN = "und"
_LETTER = r"\p{L}"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # (256, EMBEDDING); byte 0 is padding
    filters: list[np.ndarray]  # for each width: (width * EMBEDDING, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    dense: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    dense_bias: np.ndarray

    def folded(self) -> Folded:
        """The first layer as tables over byte pairs."""
        at = [np.stack([self.embedding @ w[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(n)]) for n, w in zip(WIDTHS, self.filters, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        head = np.concatenate([pair(x[0], x[1]) for x in at], axis=1)
        tail = np.concatenate([pair(at[1][2], np.zeros_like(at[1][2])), pair(at[2][2], at[2][3])], axis=1)
        return Folded(self.languages, head.astype(np.float32), tail.astype(np.float32), self.bias, self.dense, self.dense_bias)


@dataclass
class Folded:
    languages: list[str]
    head: np.ndarray
    tail: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """For rows of WINDOW bytes."""
        out = []
        for k in range(0, len(windows), 32):
            w = windows[k : k + 32].astype(np.int32)
            pairs = w[:, :-1] * 256 + w[:, 1:]
            x = self.head[pairs[:, :-2]]
            x[:, :, FILTERS:] += self.tail[pairs[:, 2:]]
            out.append(np.maximum(x.max(axis=1) + self.bias, 0))
        z = np.concatenate(out) @ self.dense + self.dense_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on the cross-entropy; gradients pass the pooling only at each filter's strongest place."""
    r = np.random.default_rng(seed)
    n_out = len(WIDTHS) * FILTERS
    embedding = r.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
    embedding[0] = 0
    p = [embedding, *[r.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]]
    p += [np.zeros(n_out, np.float32), r.normal(0, n_out**-0.5, (n_out, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    rows = np.arange(BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(windows))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            x, y = windows[pick], labels[pick]
            b = rows[: len(pick)]
            e = p[0][x]  # (batch, WINDOW, EMBEDDING)
            pooled, places = [], []
            for i, w in enumerate(WIDTHS):
                span = WINDOW - max(WIDTHS) + 1
                z = sum(e[:, o : o + span] @ p[1 + i][o * EMBEDDING : (o + 1) * EMBEDDING] for o in range(w))
                places.append(z.argmax(axis=1))
                pooled.append(np.take_along_axis(z, places[-1][:, None, :], axis=1)[:, 0])
            h = np.maximum(np.concatenate(pooled, axis=1) + p[-3], 0)
            z = h @ p[-2] + p[-1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[b, y] -= 1
            d /= len(pick)
            g = [np.zeros_like(a) for a in p]
            g[-2], g[-1] = h.T @ d, d.sum(axis=0)
            dh = (d @ p[-2].T) * (h > 0)
            g[-3] = dh.sum(axis=0)
            for i, w in enumerate(WIDTHS):
                dw = dh[:, i * FILTERS : (i + 1) * FILTERS]
                for o in range(w):
                    at = places[i] + o
                    block = slice(o * EMBEDDING, (o + 1) * EMBEDDING)
                    g[1 + i][block] = np.einsum("bfe,bf->ef", e[b[:, None], at], dw)
                    np.add.at(g[0], x[b[:, None], at], dw[:, :, None] * p[1 + i][block].T[None])
            g[0][0] = 0
            t += 1
            for a, ga, ma, va in zip(p, g, m, v, strict=True):
                ma += 0.1 * (ga - ma)
                va += 0.001 * (ga * ga - va)
                a -= RATE * (ma / (1 - 0.9**t)) / (np.sqrt(va / (1 - 0.999**t)) + 1e-8)
    return Network(languages, p[0], p[1 : 1 + len(WIDTHS)], p[-3], p[-2], p[-1])


def training_windows(docs: DataFrame) -> DataFrame:
    """(lang, window) of at most about TEXTS_PER_LANGUAGE texts a language and TEXTS in all, WINDOWS_PER_TEXT windows each.

    Texts are drawn by a hash of their id; windows lie anywhere in the text, drawn by a hash as well. All languages have the
    same number of texts if they have as many.
    """
    counts = sent_if_small(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    kinds = counts.count()
    if not kinds:
        return docs.sparkSession.createDataFrame([], "lang string, window binary")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = docs.join(counts, "lang").filter(unit < min(TEXTS_PER_LANGUAGE, TEXTS / kinds) / F.col("_n")).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, windows = [], []
            for doc_id, lang, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                raw = text.encode()
                for k in range(min(WINDOWS_PER_TEXT, -(-len(raw) // WINDOW))):
                    at = zlib.crc32(f"{doc_id}:{k}".encode()) % max(1, len(raw) - WINDOW + 1)
                    langs.append(lang)
                    windows.append(raw[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])

    return drawn.mapInArrow(run, "lang string, window binary")


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Trains on the rows of ``docs`` with a text that has a letter and a language; None if there are none."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(_LETTER))
    sample = sorted((r.lang, bytes(r.window)) for r in training_windows(rows).collect())
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    x = np.zeros((len(sample), WINDOW), np.uint8)
    for row, (_, raw) in zip(x, sample, strict=True):
        row[: len(raw)] = np.frombuffer(raw, np.uint8)
    return train(x, np.array([number[lang] for lang, _ in sample]), languages)


def predict(docs: DataFrame, network: Network | None, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ``keep`` columns, lang_pred and score.

    Null texts and texts without a letter are ``und`` with score 0, and so is all without a network. Whole
    texts count; repeated rows are judged each; an empty table gives no rows. Rows stay in their partition.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(network.folded() if network else None)  # about 20 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                names, scores = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
                for i, text in enumerate(b.column("text")):
                    if net and b.column(letter)[i].as_py():
                        raw = text.as_py().encode()
                        w = windows_of(raw)
                        weight = np.full(len(w), WINDOW, float)
                        weight[-1] = len(raw) - WINDOW * (len(w) - 1)
                        z = weight @ net.log_probabilities(w) / weight.sum()
                        p = np.exp(z - z.max())
                        best = int(p.argmax())
                        names[i], scores[i] = net.languages[best], float(p[best] / p.sum())
                rest = [c for c in b.schema.names if c not in ("text", letter)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    rows = docs.select(docs[id_col].alias("doc_id"), *[docs[c] for c in keep], docs[text_col].cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    letter = fresh(rows.columns, "letter")
    rows = rows.withColumn(letter, F.coalesce(F.col("text").rlike(_LETTER), F.lit(False)))
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    network = fit(docs.filter(~F.col("held_out") & F.col("lang").isNotNull()))
    return predict(docs, network, keep=("held_out",))
