import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamix.operators import binning, clouds, coreset, em, labeling, merge, predict, summaries, univariate
from stratamix.plans.model import MixtureClusterer, MixtureModel
from stratamix.sources import frame

from model_tables import clusters as _clusters
from model_tables import components as _components
from model_tables import mapping as _mapping
from model_tables import rules as _rules


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal([0, 0], 0.3, (1500, 2)), r.normal([3, 0], 0.3, (1500, 2)), r.normal([3, 3], 0.3, (2000, 2))])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").cache()


def test_boundary_null_and_nan_have_the_lower_level(spark):
    df = spark.createDataFrame([(1.0,), (1.0000001,), (None,), (float("nan"),), (9.0,)], "x double")
    got = [r.l for r in df.select(binning.level(F.col("x"), [1.0, 2.0]).alias("l")).collect()]
    assert got == [1, 2, 1, 1, 3]


def test_no_cutoffs_give_one_bin(spark):
    s = binning.bin_summary(binning.with_bins(spark.range(5).withColumn("x", F.lit(1.0)), {})).collect()
    assert [(r.bin_key, r.n) for r in s] == [("", 5)]


def test_equal_sizes_rank_by_falling_id(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (2.0,), (2.0,), (5.0,)], "x double")
    s = {r.bin_key: (r.bin_id, r.size_rank) for r in binning.bin_summary(binning.with_bins(df, {"x": [1.0, 3.0]})).collect()}
    assert s == {"1": (1, 2), "2": (2, 1), "3": (3, 3)}


def test_many_bins_are_numbered_without_one_task(spark):
    """200,000 bins by ranges: the ids and ranks that an ordering in one place gives, and no window in the plan."""
    i = F.col("id")
    rows = spark.range(200_000).select(F.pmod(i * 7919, F.lit(200_000)).alias("a"), F.lit(1).alias("b")).unionByName(spark.range(5000).select((i * 17).alias("a"), F.lit(1).alias("b")))
    binned = rows.select(F.array("a").alias("levels"), F.col("a").cast("string").alias("bin_key"))
    s = binning.bin_summary(binned)
    assert "Window" not in s._jdf.queryExecution().executedPlan().toString()
    got = s.toPandas().sort_values("bin_id")
    assert got.bin_id.tolist() == list(range(1, 200_001)) and [x[0] for x in got.levels[:3]] == [0, 1, 2]
    by = got.sort_values(["n", "bin_id"], ascending=False)
    assert by.size_rank.tolist() == list(range(1, 200_001)) and by.n.iloc[0] == 2
    assert frame.numbered(spark.range(0), "k", F.col("id")).count() == 0


def test_bins_of_exactly_the_threshold_are_not_initial(spark):
    df = spark.createDataFrame([(0.0, 1.0)] * 3 + [(2.0, 1.0)] * 4, "x double, y double")
    s = binning.bin_summary(binning.with_bins(df, {"x": [1.0]}))
    assert [r.n for r in coreset.initial_bins(s, 5, 3).collect()] == [4]


def test_single_row_has_zero_covariance_and_weight_one(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 3.0)], "bin_id int, bin_n long, x double, y double")
    r = coreset.coreset(df, ["x", "y"], smallest=1, largest=5).first()
    assert r.weight == 1 and r["cov"] == [0.0] * 4


def test_coreset_weights_sum_to_the_kept_rows(spark, planted):
    placed = binning.with_bins(planted, {"a": [1.5], "b": [1.5]})
    placed = binning.with_bin_ids(placed, binning.bin_summary(placed))
    for splitter in ("kmeans", "median"):
        core = coreset.coreset(placed, ["a", "b"], smallest=5, largest=200, splitter=splitter)
        assert core.agg(F.sum("weight")).first()[0] == 5000


def test_huge_bins_are_split_by_passes_over_all_rows(spark, planted, monkeypatch):
    monkeypatch.setattr(coreset, "MOST_ROWS", 400)
    placed = binning.with_bins(planted, {"a": [1.5]})
    placed = binning.with_bin_ids(placed, binning.bin_summary(placed))
    core = coreset.coreset(placed, ["a", "b"], smallest=5, largest=200).toPandas()
    assert core.weight.sum() == 5000 and not core.duplicated(["bin_id", "piece"]).any()
    assert core.groupby("bin_id").size().to_dict() == {1: 8, 2: 18}
    mean = np.average(np.stack(core["mean"]), axis=0, weights=core.weight)
    assert np.allclose(mean, list(planted.agg(F.avg("a"), F.avg("b")).first()), atol=1e-3)


@pytest.mark.parametrize("splitter", ["kmeans", "median"])
def test_huge_bins_of_few_values_are_split_too(spark, monkeypatch, splitter):
    """A third of the rows are equal, and the widest column has two values."""
    monkeypatch.setattr(coreset, "MOST_ROWS", 300)
    i = F.col("id")
    rows = spark.range(9000).select(F.when(i < 3000, 0.0).otherwise(10.0 * (i % 2)).alias("a"), F.when(i < 3000, 0.0).otherwise((i % 701) / 701).alias("b"), F.lit(1).alias("bin_id"), F.lit(9000).cast("long").alias("bin_n"))
    core = coreset.coreset(rows, ["a", "b"], smallest=5, largest=1000, splitter=splitter).toPandas()
    assert core.weight.sum() == 9000 and not core.duplicated(["bin_id", "piece"]).any()
    mean = rows.agg(F.avg("a"), F.avg("b")).first()
    assert np.allclose((np.stack(core["mean"]) * core.weight.to_numpy()[:, None]).sum(axis=0) / 9000, list(mean), atol=1e-3)


def test_parallel_seeding_is_as_good_as_one_task(spark, monkeypatch):
    """Pieces of bins that are split by passes are no wider than those of k-means in one task, and don't overlap."""
    r = np.random.default_rng(31)
    x = np.concatenate([r.normal(c, 0.2, (300, 2)) for c in r.uniform(-20, 20, (12, 2))])
    rows = spark.createDataFrame([(b, float(p), float(q)) for b in (1, 2) for p, q in x * b], "bin_id int, a double, b double").repartition(6)
    centers = clouds.kmeans_centers(rows, ["a", "b"], {1: 12, 2: 12})
    label, far = clouds.nearest(np.round(x, 3), centers[1])
    one = coreset.kmeans(np.round(x, 3), 12, 3, 3)
    within = sum(((x[one == k] - x[one == k].mean(axis=0)) ** 2).sum() for k in np.unique(one))
    assert len(centers[1]) <= 12 and far.sum() <= within * 1.02
    placed = clouds.with_centers(rows, ["a", "b"], centers).filter("bin_id = 1").toPandas()
    again, _ = clouds.nearest(np.round(placed[["a", "b"]].to_numpy(), 3), centers[1])
    assert (placed.piece.to_numpy() == again + 1).all()
    assert [len(c) for c in clouds.kmeans_centers(rows.filter("a = 1e9 or bin_id = 1 and a < 1e9").withColumns({"a": F.lit(1.0), "b": F.lit(2.0)}), ["a", "b"], {1: 5}).values()] == [1]


def test_bins_are_joined_the_same_way_beyond_the_bound(spark, planted, monkeypatch):
    cuts = {"a": [1.5], "b": [1.5]}
    placed = binning.with_bins(planted, cuts)
    summary = binning.bin_summary(placed)
    sent = binning.with_bin_ids(placed, summary, cuts)
    monkeypatch.setattr(binning, "MOST_SENT", 2)
    joined = binning.with_bin_ids(placed, summary, cuts)
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
    assert joined.exceptAll(sent).count() == 0 and joined.count() == 5000


def test_a_fit_leaves_nothing_in_storage(spark, planted, monkeypatch, tmp_path):
    monkeypatch.setattr(coreset, "MOST_ROWS", 700)
    planted.count()
    before = spark._jsc.getPersistentRDDs().size()
    for splitter in ("kmeans", "median"):
        model = MixtureClusterer(params=["a", "b"], components=4, splitter=splitter, max_bin_size=300, pooling=0.1, journal=str(tmp_path / splitter)).fit(planted)
        assert len(model.mixture.pro) >= 3 and any((tmp_path / splitter).iterdir())
    univariate.fit_univariate(planted, ["a"], 2, sample_fraction=0.1)
    assert spark._jsc.getPersistentRDDs().size() == before


def test_one_feature_and_default_features(spark, planted):
    model = MixtureClusterer(params=["a"], components=3).fit(planted)
    assert model.mixture.cov.shape[1:] == (1, 1) and model.mixture.pro.sum() == pytest.approx(1, abs=1e-6)
    scored = model.transform(planted).groupBy((F.col("a") > 1.5).alias("high"), "cluster").count().collect()
    assert max(r["count"] for r in scored if r.high) > 3300 and max(r["count"] for r in scored if not r.high) > 1400
    df = planted.select("a", "b", F.lit(3).alias("Original"))
    assert frame.numeric_columns(df) == ["a", "b"]
    assert MixtureClusterer(components=3).fit(df).params == ["a", "b"]


def test_fit_recovers_planted_clusters(spark, planted, tmp_path):
    model = MixtureClusterer(params=["a", "b"], components=4).fit(planted)
    assert model.mixture.pro.sum() == pytest.approx(1, abs=1e-6)
    assert all(np.linalg.eigvalsh(c).min() > 0 for c in model.mixture.cov)
    scored = model.transform(planted)
    truth = F.when(F.col("id") < 1500, 0).when(F.col("id") < 3000, 1).otherwise(2)
    best = scored.groupBy(truth.alias("t"), "cluster").count().groupBy("t").agg(F.max("count").alias("m")).agg(F.sum("m")).first()[0]
    assert best > 4900
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    model.save(str(tmp_path / "m"))
    again = MixtureModel.load(spark, str(tmp_path / "m"))
    assert again.transform(planted).exceptAll(scored).count() == 0
    assert model.embedding().count() == len(set(model.cluster_of))
    assert model.intensity_panels().filter("is_legend_marker").select("marker").distinct().count() == 1
    assert model.bars(sorted(set(model.cluster_of))).count() > 0


def test_native_and_arrow_scores_agree(spark, planted, monkeypatch):
    m = em.Mixture(["a", "b"], np.array([0.5, 0.5]), np.array([[0.0, 0.0], [3.0, 3.0]]), np.stack([np.eye(2)] * 2))
    rows = planted.unionByName(spark.createDataFrame([(-1, None, 1.0), (-2, float("nan"), 1.0)], planted.schema))
    native = {r.id: r.component for r in predict.with_component(rows, m).collect()}
    monkeypatch.setattr(predict, "NATIVE_PRODUCTS", 0)
    assert {r.id: r.component for r in predict.with_component(rows, m).collect()} == native
    assert native[-1] is None and native[-2] is None


def test_equal_densities_go_to_the_first(spark):
    m = em.Mixture(["a", "b"], np.array([0.5, 0.5]), np.array([[0.0, 0.0], [0.0, 0.0]]), np.stack([np.eye(2)] * 2))
    assert predict.with_component(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), m).first().component == 1


def test_variance_correction_only_when_stopped(spark):
    core = spark.createDataFrame([(1.0, [0.0, 0.0], [1.0, 0.0, 0.0, 1.0]), (1.0, [1.0, 2.0], [1.0, 0.0, 0.0, 1.0]), (1.0, [3.0, 1.0], [1.0, 0.0, 0.0, 1.0])], "weight double, mean array<double>, cov array<double>")
    start = em.Mixture(["a", "b"], np.array([1.0]), np.array([[0.0, 0.0]]), np.eye(2)[None])
    plain = em.weighted_em(core, start, steps=1)
    wide = em.weighted_em(core, start, steps=1, always_correct=True)
    assert np.allclose(wide.cov - plain.cov, np.eye(2)[None])


def test_a_lost_run_goes_on_from_its_journal(spark, planted, tmp_path, monkeypatch):
    core = planted.select(F.lit(1.0).alias("weight"), F.array("a", "b").alias("mean"), F.array(*[F.lit(0.0)] * 4).alias("cov")).persist()
    start = em.random_mixture(core, ["a", "b"], 3, seed=4)
    whole = em.weighted_em(core, start, steps=7, threshold=0.0)
    passes, plain = [], em._distributed

    def fails(*args):
        passes.append(1)
        if len(passes) == 5:
            raise RuntimeError("the driver is lost")
        return plain(*args)

    monkeypatch.setattr(em, "_distributed", fails)
    with pytest.raises(RuntimeError):
        em.weighted_em(core, start, steps=7, threshold=0.0, journal=str(tmp_path / "j"))
    assert em.Journal(spark, str(tmp_path / "j")).last()[0] == 3
    (tmp_path / "j" / "step=9").mkdir()  # begun, never finished
    again = em.weighted_em(core, start, steps=7, threshold=0.0, journal=str(tmp_path / "j"))
    assert len(passes) == 5 + 5 and np.allclose(again.mean, whole.mean) and np.allclose(again.cov, whole.cov) and np.allclose(again.pro, whole.pro)


def test_few_rows_of_sums_reach_the_driver(spark, planted, monkeypatch):
    core = planted.repartition(40).select(F.lit(1.0).alias("weight"), F.array("a", "b").alias("mean"), F.array(*[F.lit(0.0)] * 4).alias("cov"))
    parts, plain = [], em._distributed
    monkeypatch.setattr(em, "_distributed", lambda c, *rest: parts.append(c.rdd.getNumPartitions()) or plain(c, *rest))
    em.weighted_em(core, em.random_mixture(core, ["a", "b"], 2), steps=1)
    monkeypatch.setattr(em, "REPRESENTATIVES", 1000)
    em.weighted_em(core, em.random_mixture(core, ["a", "b"], 2), steps=1)
    assert parts == [1, 1, 5, 5]


def test_random_start_is_seeded_and_finds_planted_clusters(planted):
    """Rows as means, equal shares, identity covariances; on raw rows of weight one."""
    core = planted.select(F.lit(1.0).alias("weight"), F.array("a", "b").alias("mean"), F.array(*[F.lit(0.0)] * 4).alias("cov")).persist()
    start = em.random_mixture(core, ["a", "b"], 3, seed=2)
    rows = {(r.a, r.b) for r in planted.select("a", "b").collect()}
    assert all(tuple(m) in rows for m in start.mean) and (start.cov == np.eye(2)).all() and start.pro.tolist() == [1 / 3] * 3
    assert (em.random_mixture(core.repartition(3), ["a", "b"], 3, seed=2).mean == start.mean).all()
    best = min((em.weighted_em(core, em.random_mixture(core, ["a", "b"], 3, seed=s), steps=60, threshold=1e-6).mean for s in range(4)), key=lambda m: sum(((m - c) ** 2).sum(axis=1).min() for c in ([0, 0], [3, 0], [3, 3])))
    assert sum(((best - c) ** 2).sum(axis=1).min() for c in ([0, 0], [3, 0], [3, 3])) < 0.05


def test_cluster_ids_follow_first_appearance(spark):
    rows = sorted((r.component, r.cluster) for r in _mapping(spark).collect())
    assert rows[0] == (1, 1) and [c for _, c in rows] == [1, 2, 1, 3, 2]
    assert merge.polymorphic(_mapping(spark), ["m1", "m2", "m3"]) == ["m1", "m2"]
    assert merge.cluster_sds(_components(spark), _mapping(spark), ["m1", "m2", "m3"]).filter("sd <= 0").count() == 0


def test_labels_first_match_unknown_and_overwrite(spark):
    funcs = labeling.first_match(_clusters(spark), _rules(spark), ["m1", "m2"])
    got = {r.cluster: (r.func, r.label) for r in labeling.label_strings(_clusters(spark), funcs, _rules(spark), ["m1", "m2"]).collect()}
    assert got == {1: ("UNK", "UNK"), 2: ("alpha", "alpha"), 3: ("beta", "beta m3+"), 4: ("beta", "beta m3++"), 5: ("alpha", "alpha m3++"), 6: ("gamma", "gamma")}
    open_rules = spark.createDataFrame([(1, "any", "dc", "dc")], "rule_order int, label string, m1 string, m2 string")
    one = spark.createDataFrame([(1, 3, 2, 1)], "cluster int, m1 int, m2 int, m3 int")
    funcs = labeling.first_match(one, open_rules, ["m1", "m2"])
    assert labeling.label_strings(one, funcs, open_rules, ["m1", "m2"]).first().label == "any m2+"
    assert labeling.label_strings(one, funcs, open_rules, ["m1", "m2"], fixed=True).first().label == "any m1++ m2+"


def test_rules_on_a_constant_marker_are_refused(spark):
    with pytest.raises(ValueError, match="m9"):
        labeling.first_match(_clusters(spark), _rules(spark), ["m9"])


def test_rows_are_embedded_by_a_sample(planted):
    scored = planted.withColumn("cluster", F.when(F.col("id") < 1500, 1).when(F.col("id") < 3000, 2).otherwise(3))
    got = summaries.row_embedding(scored, ["a", "b"], size=300, seed=1).toPandas()
    assert len(got) == 300 and set(got.cluster) == {1, 2, 3}
    centers = got.groupby("cluster")[["tsne_1", "tsne_2"]].mean()
    d = ((got[["tsne_1", "tsne_2"]].to_numpy()[:, None] - centers.to_numpy()) ** 2).sum(axis=2)
    assert (centers.index.to_numpy()[d.argmin(axis=1)] == got.cluster).mean() > 0.95


def test_input_errors(spark, planted):
    with pytest.raises(ValueError, match="missing"):
        MixtureClusterer(params=["a", "zz"]).fit(planted)
    with pytest.raises(ValueError, match="one feature"):
        MixtureClusterer().fit(planted.select(F.col("id").cast("string")))
    with pytest.raises(ValueError, match="not numeric"):
        frame.require(spark.createDataFrame([("x",)], "a string"), ["a"])


def test_exact_sample_is_exact_and_repeats(planted):
    one = {r.id for r in frame.sample_rows(planted, 777, by=["id"]).collect()}
    assert len(one) == 777 and one == {r.id for r in frame.sample_rows(planted.repartition(7), 777, by=["id"]).collect()}
    placed = [r.id for r in frame.sample_rows(planted, 777).collect()]
    assert len(set(placed)) == 777 and sorted(placed) == sorted(r.id for r in frame.sample_rows(planted, 777).collect())
    assert one != {r.id for r in frame.sample_rows(planted, 777, seed=1, by=["id"]).collect()}
    assert frame.sample_rows(planted, 0).count() == 0 and frame.sample_rows(planted, 5000).count() == 5000


@pytest.mark.parametrize("slots", [4096, 3])
def test_equal_rows_are_drawn_one_by_one(spark, monkeypatch, slots):
    monkeypatch.setattr(frame, "SLOTS", slots)
    # a third of the rows are zeros, the rest are 50 values of 400 rows each
    df = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0.0).otherwise(F.col("id") % 50 + 1).alias("x"))
    got = {r.x: r["count"] for r in frame.sample_rows(df, 900).groupBy("x").count().collect()}
    assert sum(got.values()) == 900
    # chi-square with 50 degrees of freedom: 0.9999 lies at about 94
    wanted = {x: 300 if x == 0 else 12 for x in range(51)}
    assert sum((got.get(float(x), 0) - e) ** 2 / e for x, e in wanted.items()) < 94
    assert frame.sample_rows(df, 1).count() == 1


def test_sampling_shuffles_no_rows_by_value(planted):
    """The rows that pass the first bound are made once where they are; draws are ordered in one slot alone."""
    out = frame.sample_rows(planted, 500, by=["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 500 and "hashpartitioning" not in plan and "rangepartitioning" not in plan and "TakeOrdered" in plan


def test_rule_file_with_bare_carriage_returns(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b",m1,m2\rA,hi,lo\rB,lo,dc")
    rows = frame.read_rules(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.rule_order, r.label, r.m1, r.m2) for r in rows] == [(1, "A", "hi", "lo"), (2, "B", "lo", "dc")]


def test_stream_scores_like_batch(spark, planted, tmp_path):
    from stratamix.streaming.score import score_folder

    m = em.Mixture(["a", "b"], np.array([0.5, 0.5]), np.array([[0.0, 0.0], [3.0, 3.0]]), np.stack([np.eye(2)] * 2))
    model = MixtureModel.of(spark, m, [], {"a": [1.5]})
    planted.write.parquet(str(tmp_path / "in"))
    score_folder(spark, model, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), planted.schema).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(model.transform(planted)).count() == 0
