import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamix.operators import coreset, medians


@pytest.fixture(scope="module")
def binned(spark):
    """Bins of very different sizes: spread values, a third of equal rows, values over many magnitudes, few values, one row, nulls."""
    r = np.random.default_rng(21)
    rows = [(1, float(a), float(b)) for a, b in r.normal(size=(900, 2)) * [1, 4]]
    rows += [(2, 5.0, 5.0)] * 300 + [(2, float(a), float(b)) for a, b in r.normal(size=(600, 2)).round(1)]
    rows += [(3, float(10.0 ** r.integers(-100, 100)) * (1 + i / 1000), 0.0) for i in range(500)]
    rows += [(4, float(i % 2), 1.0) for i in range(400)]
    rows += [(5, 1.0, 1.0)] * 700
    rows += [(6, None if i % 7 == 0 else float(i), float("nan") if i % 5 == 0 else 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "bin_id int, a double, b double")
    sizes = df.groupBy("bin_id").agg(F.count(F.lit(1)).alias("bin_n"))
    return rows, df.join(sizes, "bin_id").repartition(5).persist()


def table(df):
    return sorted((r.bin_id, r.piece, r.weight, shown(r["mean"])) for r in df.collect())


def shown(means):
    return tuple(f"{x:.8e}" if abs(x) > 1e-9 else "0" for x in means)


@pytest.mark.parametrize(("held", "cells"), [(10, 8), (100, 2048)])
def test_the_tree_cuts_as_one_task_does(binned, monkeypatch, held, cells):
    rows, df = binned
    df = df.filter("bin_id <> 6")
    whole = table(coreset.median_pieces(df, ["a", "b"], 30))
    monkeypatch.setattr(coreset, "MOST_ROWS", held)
    monkeypatch.setattr(medians, "CELLS", cells)
    assert table(coreset.median_pieces(df, ["a", "b"], 30)) == whole
    by = {}
    for b, a, c in rows:
        by.setdefault(b, []).append((a, c))
    for b in range(1, 6):
        x = np.array(by[b])
        label = medians.halves(x, coreset.halving_depth(len(x), 30))
        wanted = [(int((label == k).sum()), shown(x[label == k].mean(axis=0))) for k in np.unique(label)]
        assert [(w, m) for i, _, w, m in whole if i == b] == wanted


def test_medians_are_exact(spark, binned):
    _, df = binned
    huge = df.filter("bin_id in (1, 2, 3, 4)").select("bin_id", "a", "b")
    tree = medians.median_tree(huge, ["a", "b"], {1: 1, 2: 1, 3: 1, 4: 1}, 10)
    for i, b in enumerate(tree.bins):
        x = np.array([(r.a, r.b) for r in huge.filter(F.col("bin_id") == int(b)).collect()])
        with np.errstate(over="ignore"):
            axis = int(np.nanargmax(x.std(axis=0)))
        assert tree.axis[tree.first[i] + 1] == axis and tree.cut[tree.first[i] + 1] == pytest.approx(np.median(x[:, axis]), rel=1e-15)


def test_rows_without_values_lie_below_every_cut(binned, monkeypatch):
    _, df = binned
    monkeypatch.setattr(coreset, "MOST_ROWS", 50)
    got = coreset.median_pieces(df.filter("bin_id = 6"), ["a", "b"], 100).collect()
    assert sum(r.weight for r in got) == 300 and len(got) == 4


def test_pieces_weigh_all_rows_of_a_coreset(binned):
    _, df = binned
    core = coreset.coreset(df.filter("bin_id <> 6"), ["a", "b"], smallest=5, largest=50, splitter="median")
    assert core.agg(F.sum("weight")).first()[0] == 900 + 900 + 500 + 400 + 700


def test_repeated_rows_are_held_and_passed_over_once(spark, monkeypatch):
    """Twenty copies of each row give the pieces of the plain rows' halves, and no more passes over the rows than one copy takes."""
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(80, 2)).round(3), 20, axis=0)
    x[:400, 1] = 0.5
    df = spark.createDataFrame([(1, len(x), float(a), float(b)) for a, b in x], "bin_id int, bin_n long, a double, b double")
    label = medians.halves(x, coreset.halving_depth(len(x), 30))
    wanted = [(1, i + 1, int((label == k).sum()), shown(x[label == k].mean(axis=0))) for i, k in enumerate(np.unique(label))]
    monkeypatch.setattr(coreset, "MOST_ROWS", 10)
    assert table(coreset.median_pieces(df, ["a", "b"], 30)) == wanted
    monkeypatch.setattr(coreset, "MOST_ROWS", 100)
    monkeypatch.setattr(coreset, "median_tree", lambda *a: pytest.fail("80 different rows need no tree"))
    got = coreset.median_pieces(df, ["a", "b"], 30)
    assert table(got) == wanted
    for piece, row in zip(np.unique(label), sorted(got.collect(), key=lambda g: g.piece), strict=True):
        assert row["cov"] == pytest.approx(np.cov(x[label == piece].T, ddof=1).ravel(), abs=1e-12)
