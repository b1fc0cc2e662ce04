import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamix.llm import fingerprints as fp

DOCS = "doc_id long, text string, n_chars string, bucket int, h string, guest int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], DOCS).repartition(parts)


def brute(rows):
    """Rows in falling order of ids, nulls last, each with the one after it. Ids are unique."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (fp.sketch(x) for x in (t, edited, after))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.as_string(a), fp.as_string(b), fp.likeness(a, b), fp.likeness(a, c))
    return out


def prose(r, n):
    return " ".join("".join(r.choices("abcdeéß😀mnop", k=r.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("parts", [1, 4])
def test_neighbours_and_edits(spark, parts):
    r = random.Random(3)
    ids = r.sample(range(-(10**12), 10**12), 60) + list(range(200)) + [2**63 - 1, -(2**63), None]
    rows = [(i, r.choice([prose(r, r.randint(0, 60)), "", None, "x", "copy of a text that many rows have"])) for i in ids]
    rows[5] = (rows[5][0], prose(r, 30_000))
    got = {x.doc_id: tuple(x)[1:] for x in fp.edited_fingerprints(frame(spark, rows, parts)).collect()}
    assert got == brute(rows)


def test_hot_ids_are_cut_by_text(spark):
    """A third of the rows have no id and a third the same: they lie in many buckets, and all rows come back once."""
    r = random.Random(4)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{i} {prose(r, 5)}") for i in range(900)]
    docs = frame(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("h"))
    placed = fp.in_neighbourhoods(docs, 8).filter("not guest").groupBy("bucket").count().toPandas()
    assert placed["count"].sum() == 900 and placed["count"].max() < 120
    got = fp.edited_fingerprints(frame(spark, rows)).collect()
    assert len(got) == 900 and sum(x.doc_id == 7 for x in got) == 300
    # equal ids follow each other by the hash of their texts
    order = [(x.doc_id, x.text) for x in docs.orderBy(F.asc_nulls_first("doc_id"), "h").collect()]
    wanted = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[k - 1][1][: len(t) // 2]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(x.edited_sha256 for x in got) == wanted


def test_one_row_repeated_rows_and_none(spark):
    assert fp.edited_fingerprints(frame(spark, [])).collect() == []
    one = fp.edited_fingerprints(frame(spark, [(1, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    twice = fp.edited_fingerprints(frame(spark, [(1, "some text here"), (1, "some text here"), (2, None)])).collect()
    assert len(twice) == 3 and len({x.fingerprint for x in twice}) == 2
    assert fp.edited_fingerprints(frame(spark, [(1, None), (2, "")])).first().near_edited == 1.0


@pytest.mark.parametrize("shingle", [1, 2, 3, 7, 16, 21])
def test_hashes_are_those_of_the_shingles(shingle):
    text = prose(random.Random(shingle), 30)
    h = fp.shingle_hashes(text, shingle)
    runs = [text[i : i + shingle] for i in range(len(text) - shingle + 1)]
    assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs))
    by = dict(zip(runs, h.tolist(), strict=True))
    assert [by[x] for x in runs] == h.tolist() and all(fp.shingle_hashes(x, shingle)[0] == v for x, v in by.items())
    assert fp.shingle_hashes("ab", 3)[0] != fp.shingle_hashes("abc", 3)[0] and not len(fp.shingle_hashes("", shingle))


def test_likeness_follows_the_true_share():
    r = random.Random(8)
    errors = []
    for share in np.linspace(0, 1, 60):
        a, b = prose(r, 400), prose(r, 400)
        b = a[: int(len(a) * share)] + b[int(len(a) * share) :]
        sets = [{t[i : i + fp.SHINGLE] for i in range(len(t) - fp.SHINGLE + 1)} for t in (a, b)]
        errors.append(fp.likeness(fp.sketch(a), fp.sketch(b)) - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert np.abs(errors).mean() < 0.03 and abs(np.mean(errors)) < 0.015
    assert (fp.of_string(fp.as_string(fp.sketch(a))) == fp.sketch(a)).all()


def test_merged_sketches_and_containment(spark):
    r = random.Random(9)
    texts = [prose(r, 150) for _ in range(30)]
    # a collection's sketch is that of all its shingles
    docs = spark.createDataFrame([(i, t, "even" if i % 2 == 0 else "odd") for i, t in enumerate([*texts, "short", ""])], "doc_id long, text string, part string")
    own = fp.sketches(docs).join(docs.select("doc_id", "part"), "doc_id")
    both = fp.merged(own, "part")
    got = {(x.part, x["hash"]) for x in both.collect()}
    assert got == {(("even", "odd")[i % 2], int(h)) for i, t in enumerate(texts) for h in fp.sketch(t)}
    parts = spark.createDataFrame([(100, texts[0][:700] + prose(r, 80)[:700]), (101, texts[1])], "doc_id long, text string")
    shares = {(x.doc_id, x.part): x.contained for x in fp.containments(fp.sketches(parts), both, "part").collect()}
    assert shares[101, "odd"] == 1.0 and abs(shares[100, "even"] - 0.5) < 0.15 and (101, "even") not in shares
    # texts without small hashes keep their least one until a smaller is there
    few = spark.createDataFrame([(1, [fp.BOUND + 5], "a"), (2, [fp.BOUND + 3], "a"), (3, [fp.BOUND + 1], "b"), (4, [7, 8], "b")], "doc_id long, hashes array<long>, part string")
    assert {(x.part, x["hash"]) for x in fp.merged(few, "part").collect()} == {("a", fp.BOUND + 3), ("b", 7), ("b", 8)}
