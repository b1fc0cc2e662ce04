import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamix.llm import ann

SF = "/root/testdata/sf0.001"


def exact(rows, k, every):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    dims = [len(v) for v in good.values()]
    dim = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 0
    good = {i: v for i, v in good.items() if len(v) == dim}
    return {q: sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:k] for q in good if q % every == 0}, good


def test_recall_scores_and_order(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, good = exact(rows, 20, 20)
    got: dict = {}
    for r in ann.op5_ann(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - float(good[q] @ good[i])) < 1e-12 for _, i, s in found)
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_lengths_that_differ(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 16)) * r.uniform(0.2, 4, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, _ = exact(rows, 10, 20)
    got: dict = {}
    for q in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10).collect():
        got.setdefault(q.query_id, set()).add(q.vec_id)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * 10 * len(want)


def test_few_rows_hot_copies_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 200)] + [(201, [0.5, 1.0, 0.0]), (220, [0.0, 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (240, None), (260, [0.0, 0.0, 0.0]), (280, [1.0, None, 0.0]), (300, [float("nan"), 1.0, 0.0]), (320, [float("inf"), 1.0, 0.0]), (340, [1.0, 2.0]), (360, []), (0, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, shard int, score double")
    want, _ = exact(rows, 20, 20)
    got: dict = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(f)] for q, f in got.items()} == {q: [i for _, i in w] for q, w in want.items()}
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.filter("vec_id = 260")).count() == 0
    few = ann.nearest(df.filter("vec_id in (20, 201, 220)")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == [(20, 1, 201), (20, 2, 220), (220, 1, 201), (220, 2, 20)]


def test_shards_and_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 100)
    monkeypatch.setattr(ann, "BLOCK", 7)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, _ = exact(rows, 20, 20)
    got: dict = {}
    for r in ann.op5_ann(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_clustered_vectors_need_few_candidates(spark):
    """Where vectors have structure the trees reach a small share of a shard only, and the recall holds."""
    r = np.random.default_rng(9)
    centers = r.normal(size=(60, 48))
    x = centers[r.integers(0, 60, 4000)] + 0.25 * r.normal(size=(4000, 48))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ann.fit(df.select("vec_id", F.col("embedding").alias("v")), 20).share < 0.25
    want, _ = exact(rows, 20, 20)
    got: dict = {}
    for q in ann.nearest(df).collect():
        got.setdefault(q.query_id, set()).add(q.vec_id)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_equal_vectors_tie_exactly(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 64)
    r = np.random.default_rng(5)
    for dim in (3, 37, 64):
        distinct = r.normal(size=(24, dim)) * r.uniform(0.1, 9, (24, 1))
        ids = r.permutation(600).tolist()
        rows = [(i, distinct[n % 24].tolist()) for n, i in enumerate(ids)]
        of = dict(rows)
        found: dict = {}
        for q in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=30).collect():
            found.setdefault(q.query_id, []).append((q.rank, q.score, q.vec_id))
        assert len(found) == 30
        for q, hits in found.items():
            hits.sort()
            scores: dict = {}
            for _, score, i in hits:
                assert scores.setdefault(tuple(of[i]), score) == score
                assert abs(score - float(np.dot(of[q], of[i]))) <= 1e-9 * max(1, abs(score))
            assert [(-s, i) for _, s, i in hits] == sorted((-s, i) for _, s, i in hits)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    import random

    r = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "bdklmn" for b in "aeiou" for c in ("ra", "li", "so", "ne", "tu")]
    sentence = lambda n: " ".join(r.choices(vocabulary, k=n)).capitalize() + "."
    text = lambda: "\n".join(" ".join(sentence(12) for _ in range(4)) for _ in range(4))
    rows = [(i, text()) for i in range(60)]
    toxic = [(100 + i, text() + " clown moron scum idiot.") for i in range(20)]
    benchmark = [(i, sentence(30)) for i in range(3)]
    leaks = [(200 + i, f"{text()}\n{benchmark[i][1]}\n{sentence(20)}") for i in range(3)]
    exact_copies = [(300, rows[3][1]), (301, rows[3][1])]
    passage = sentence(70)
    shared = [(400, f"{text()}\n{passage}"), (401, f"{passage}\n{text()}")]
    base = text()
    near = [(500 + k, base.replace("\n", " ") if not k else base.replace("\n", " ").replace(".", ". x", k)) for k in range(3)]
    folder = tmp_path_factory.mktemp("planted")
    documents = rows + toxic + leaks + exact_copies + shared + near
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in documents], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in documents], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), passage


def test_pipeline_catches_what_is_planted_and_keeps_the_rest(spark, planted):
    import corpus_pipeline

    folder, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not any(100 <= i < 200 for i in kept["toxicity"]) and len(kept["toxicity"]) == 70
    assert 300 not in kept["line_dedup"] and 301 not in kept["line_dedup"]
    assert sum(passage in t for t in kept["line_dedup"].values()) == 1
    assert {500, 501, 502} & set(kept["near_dedup"]) == {500}
    assert not any(200 <= i < 300 for i in kept["decontamination"])
    assert set(range(60)) <= set(kept["decontamination"])
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["decontamination"])


def test_pipeline_stages_handle_odd_rows(spark, planted):
    import corpus_pipeline

    folder, passage = planted
    own = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    line = "a line of some length that stands in two of these rows"
    long = " ".join(f"w{i % 5003}x{i % 7}" for i in range(150_000))
    odd = [
        (None, "a text without an id that is kept as it is by all"), (None, None), (900, None), (901, ""), (902, " \n\t\n"), (903, "short"),
        (904, f"{line}\nfirst of its own lines here it is"), (904, f"{line}\nfirst of its own lines here it is"), (905, f"{line}\nsomething else that is said in this row"), (906, "x"),
        (907, long), (908, "clown moron scum idiot " * 30),
    ]
    extra = ["rep", "h", "key", "grp", "Score", "d", "component", "first", "_gone", "_gone_id", "_Left", "_own_score", "_cell"]
    docs = own.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).select("doc_id", "text", *[F.lit(str(k)).alias(c) for k, c in enumerate(extra)])
    docs = docs.repartition(3).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), folder)
        assert none.columns == docs.columns and none.count() == 0, name
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == ["doc_id", "text", *extra], name
        assert docs.select(*extra).distinct().count() == 1
    left: dict = {}
    for r in docs.filter("doc_id is null or doc_id >= 900").collect():
        left.setdefault(r.doc_id, []).append(r.text)
    assert sorted(left[None], key=str) == sorted([odd[0][1], None], key=str)
    assert left[900] == [None] and left[901] == [""] and left[902] == [" \n\t\n"] and left[903] == ["short"] and left[906] == ["x"]
    assert left[904] == [odd[6][1]] * 2 and left[905] == ["something else that is said in this row"] and left[907] == [long] and 908 not in left
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert rows.agg(F.sum("length")).first()[0] > 150_000 and rows.filter("doc_id = 900").first().length == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
