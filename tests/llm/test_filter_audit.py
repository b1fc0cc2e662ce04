import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from stratamix.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string, part string, fails int, good string"
PROSE = " ".join(f"word{i}" for i in range(60))


def brute(docs, labels):
    """Row by row, order by order."""
    first, fails = {}, []
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    for d, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": d is not None and d > first[text]}
        marks = [(q, t) for i, q, t in labels if i == d and d is not None]
        fails.append((source or "", own, any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
    out = {}
    for part in {f[0] for f in fails}:
        rows = [f for f in fails if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = rows
            for step, c in enumerate(order, 1):
                gone = [r for r in alive if r[1][c]]
                alive = [r for r in alive if not r[1][c]]
                total[c] += len(gone)
                only = sum(r[1][c] and sum(r[1].values()) == 1 for r in rows)
                out[part, "".join(order), step] = [len(alive), len(gone), sum(r[1][c] for r in rows) - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone), c]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = total[v[-1]] if isinstance(v[-1], str) else v[-1]
    return out


def run(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "x", 7, "y") for d in docs], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in fa.audit(frame, marks).collect()}


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fa, "CHUNK", 50)
    r = np.random.default_rng(5)
    texts = [PROSE, PROSE.replace("word", "Word"), PROSE + " #", "few words", "", None, "same " * 70, "SAME$ " * 70, " \t\n", PROSE + " ünï x"]
    docs = [(int(i), texts[int(r.integers(len(texts)))], [None, "", "a", "b"][int(r.integers(4))]) for i in range(300)]
    docs += [(None, PROSE, "a"), (None, PROSE, "b"), (3, PROSE, "a"), (3, PROSE, "a"), (5, "x" * 200_000, "a")]
    labels = [(int(i), [None, 0, 1][int(r.integers(3))], int(r.integers(2))) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_bitmaps_of_many_parts_and_subsets(spark):
    r = np.random.default_rng(6)
    part, fails, mark = r.integers(0, 40, 5000), r.integers(0, 8, 5000), r.random(5000) < 0.3
    for parts, subset, (kept, marked) in fa.left_by_subset(part, fails, [mark], 3):
        for k, p in enumerate(parts):
            alive = (part == p) & (fails & subset == 0)
            assert kept[k] == alive.sum() and marked[k] == (alive & mark).sum()


def test_no_rows_and_no_labels(spark):
    assert run(spark, [], []) == {}
    got = run(spark, [(1, PROSE, "a")], [])
    assert len(got) == 600 and all(v == [1, 0, 0, 0, 0, 0, 0] for v in got.values())


def test_equal_texts_in_numbers_never_meet(spark):
    """The join that finds repeats is by hash and id: no group of equal texts lands in one task."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    got = fa.judged(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.groupBy("fails").count().orderBy("fails").collect() == [(3 - 2, 1), (17, 999)]
