import math

import numpy as np
import pytest

from stratamix.functions.balls import BallTree
from stratamix.functions.normal import best_1d, choose_1d, complexity_bias, cutoff, em_1d, stepped_1d, sums_1d, with_negative
from stratamix.functions.tsne import affinities, gradient, tsne
from stratamix.operators.coreset import halving_depth, kmeans
from stratamix.operators.em import Mixture, sums, updated
from stratamix.operators.medians import halves, ordered_bits
from stratamix.sources.frame import default_fraction, sample_size

from model_tables import CROSSINGS

GOLDEN = [1.0, 1.017578125, 1.5, 1.5, 1.5, 0.6]


@pytest.mark.parametrize(("row", "expected"), zip(CROSSINGS, GOLDEN, strict=True))
def test_crossings(row, expected):
    assert cutoff(*row[1:]) == pytest.approx(expected, abs=1e-9)


def test_bias_dominates_the_plain_penalty():
    assert complexity_bias(1e4, 1) == pytest.approx(278.3, abs=0.5)


def test_em_recovers_planted_modes():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.3, 6000), r.normal(2, 0.4, 4000)])
    f = choose_1d(x)
    assert len(f.means) == 2
    assert f.means == pytest.approx([0, 2], abs=0.05)
    assert f.shares.sum() == pytest.approx(1)


def test_em_weights_stand_for_copies():
    x = np.array([0.0, 0.1, 0.2, 3.0, 3.1])
    w = np.array([1, 2, 1, 3, 1])
    a, b = em_1d(x, 2, w), em_1d(np.repeat(x, w), 2)
    assert a.means == pytest.approx(b.means, abs=1e-6)


def test_negative_values_become_a_component_in_front():
    x = np.r_[np.full(10, -1.0) + np.arange(10) / 100, np.zeros(5), 1 + np.arange(30) / 100]
    f = with_negative(em_1d(x[x > 0], 1), (10, x[x < 0].mean(), x[x < 0].var(ddof=1)), 30)
    assert f.shares == pytest.approx([0.25, 0.75])
    assert f.means[0] < 0 < f.means[1]
    assert with_negative(em_1d(x[x > 0], 1), (1, -3.0, None), 30).variances[0] == pytest.approx(x[x > 0].var())


def test_sums_of_parts_are_those_of_the_whole():
    r = np.random.default_rng(7)
    x, w = r.normal(size=500), r.random(500)
    model = (np.array([0.3, 0.7]), np.array([-1.0, 1.0]), np.array([0.5, 2.0]))
    whole, parts = sums_1d(x, w, *model), [sums_1d(x[i::3], w[i::3], *model) for i in range(3)]
    assert np.allclose(whole[0], sum(p[0] for p in parts)) and whole[1] == pytest.approx(sum(p[1] for p in parts))
    density = model[0] * np.exp(-0.5 * (x[:, None] - model[1]) ** 2 / model[2]) / np.sqrt(2 * np.pi * model[2])
    resp = density / density.sum(axis=1, keepdims=True)
    mass = (w[:, None] * resp).sum(axis=0)
    shares, means, variances = stepped_1d(whole[0], model[1], 1e-10)
    assert whole[1] == pytest.approx(w @ np.log(density.sum(axis=1))) and whole[2] == pytest.approx(w @ np.log(resp.max(axis=1)))
    assert shares == pytest.approx(mass / w.sum()) and means == pytest.approx((w * x) @ resp / mass)
    assert variances == pytest.approx([(w * resp[:, j]) @ (x - means[j]) ** 2 / mass[j] for j in range(2)])


def test_icl_prefers_separated_components():
    """BIC without bias takes two overlapping normals apart, ICL doesn't; both by the formulas, from the fits' own densities."""
    r = np.random.default_rng(11)
    x = np.r_[r.normal(0, 1, 3000), r.normal(2.2, 1, 3000)]
    fits = [em_1d(x, k) for k in (1, 2, 3)]
    for f in fits:
        density = f.shares * np.exp(-0.5 * (x[:, None] - f.means) ** 2 / f.variances) / np.sqrt(2 * np.pi * f.variances)
        bic = 2 * np.log(density.sum(axis=1)).sum() - (3 * len(f.means) - 1) * math.log(len(x))
        assert f.bic(6000) == pytest.approx(bic, rel=1e-6)
        assert f.icl(6000) == pytest.approx(bic + 2 * np.log((density / density.sum(axis=1, keepdims=True)).max(axis=1)).sum(), rel=1e-6)
    assert len(best_1d(fits, 6000, "icl").means) == 1 and len(best_1d(fits, 6000, prior_bic=0.0).means) == 2
    far = [em_1d(np.r_[x, x + 30], k) for k in (1, 2)]
    assert len(best_1d(far, 12_000, "icl").means) == 2


def test_m_step_equals_the_direct_formula():
    r = np.random.default_rng(3)
    x, w = r.normal(size=(200, 3)), r.random(200)
    w /= w.sum()
    model = Mixture(["a", "b", "c"], np.array([0.4, 0.6]), r.normal(size=(2, 3)), np.stack([np.eye(3)] * 2))
    s = sums(x, np.zeros((200, 3, 3)), w, model)
    z = model.log_weighted(x)
    resp = np.exp(z - z.max(axis=1, keepdims=True))
    resp /= resp.sum(axis=1, keepdims=True)
    new = updated(s, model.params)
    for k in range(2):
        pro = (w * resp[:, k]).sum()
        rooted = np.sqrt(w * resp[:, k])[:, None] * x
        mean = (w * resp[:, k]) @ x / pro
        m = rooted.mean(axis=0)
        cov = len(x) / pro * (np.cov(rooted.T) + np.outer(m, m)) - np.outer(mean, mean) + 0.01 * np.eye(3)
        assert new.pro[k] == pytest.approx(pro)
        assert np.allclose(new.mean[k], mean)
        assert np.allclose(new.cov[k], cov)


def test_sums_add_up_over_partitions():
    r = np.random.default_rng(4)
    x, w = r.normal(size=(90, 2)), r.random(90)
    model = Mixture(["a", "b"], np.array([0.5, 0.5]), r.normal(size=(2, 2)), np.stack([np.eye(2)] * 2))
    own = np.zeros((90, 2, 2))
    whole = sums(x, own, w, model)
    parts = sums(x[:40], own[:40], w[:40], model) + sums(x[40:], own[40:], w[40:], model)
    assert np.allclose(whole.s2, parts.s2)
    assert whole.loglik == pytest.approx(parts.loglik)


def test_empty_component_is_dropped():
    model = Mixture(["a", "b"], np.array([0.5, 0.5]), np.array([[0.0, 0.0], [1e6, 1e6]]), np.stack([np.eye(2)] * 2))
    x = np.random.default_rng(0).normal(size=(50, 2))
    assert len(updated(sums(x, np.zeros((50, 2, 2)), np.full(50, 0.02), model), model.params).pro) == 1


def test_splitters_cover_all_rows():
    x = np.random.default_rng(5).normal(size=(300, 2))
    label = kmeans(x, 7, 0, 10)
    assert len(label) == 300 and label.max() <= 6


def test_tiers_and_floor():
    assert [default_fraction(n) for n in (10_000, 10_001, 100_001, 500_001, 1_000_001)] == [1.0, 0.5, 0.1, 0.06, 0.03]
    assert sample_size(50_000, 0.05) == 10_000
    assert sample_size(5_000, 0.05) == 5_000
    assert sample_size(50_000, 0.05, floor=0) == 2_500


def test_tsne_is_finite_and_seeded():
    x = np.random.default_rng(6).normal(size=(12, 4))
    y = tsne(x, seed=1)
    assert np.isfinite(y).all() and np.array_equal(y, tsne(x, seed=1))
    assert math.isfinite(tsne(x[:2]).sum())


def test_halves_at_medians():
    x = np.random.default_rng(5).normal(size=(301, 2)) * [1, 3]
    label = halves(x, 1)
    assert (label == (x[:, 1] >= np.median(x[:, 1]))).all()
    assert np.bincount(halves(x, 3)).tolist() == [37, 38, 37, 38, 37, 38, 38, 38]
    assert halves(np.zeros((5, 2)), 2).tolist() == [3] * 5 and halves(np.zeros((1, 2)), 2).tolist() == [0]
    assert [halving_depth(n, 10) for n in (10, 11, 20, 21, 40, 41, 160)] == [0, 1, 1, 2, 2, 3, 4]


def test_ordered_bits_keep_the_order():
    v = np.array([-np.inf, -1e300, -2.0, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    b = ordered_bits(v)
    assert (np.sort(b) == b).all() and b[5] == b[6] and len(np.unique(b)) == len(v) - 1


@pytest.mark.parametrize(("k", "d", "spread"), [(1, 2, 1.0), (7, 3, 3.0), (120, 4, 40.0), (60, 2, 0.5)])
def test_ball_tree_finds_the_densest_component(k, d, spread):
    r = np.random.default_rng(k)
    root = r.normal(size=(k, d, d)) * 0.5
    cov = root @ root.transpose(0, 2, 1) + 0.05 * np.eye(d)
    model = Mixture([str(i) for i in range(d)], r.dirichlet(np.ones(k)), r.normal(size=(k, d)) * spread, cov)
    x = np.concatenate([model.mean[r.integers(0, k, 3000)] + r.normal(size=(3000, d)), r.normal(size=(50, d)) * 1e4])
    which, count = BallTree(model.pro, model.mean, model.cov).best(x)
    z = model.log_weighted(x)
    assert (which == z.argmax(axis=1)).all()
    if spread > 10:
        assert count < 0.3 * len(x) * k


def test_equal_components_give_the_first():
    model = (np.full(30, 1 / 30), np.zeros((30, 2)), np.stack([np.eye(2)] * 30))
    assert BallTree(*model).best(np.array([[0.0, 1.0], [5.0, 5.0]]))[0].tolist() == [0, 0]
    assert len(BallTree(*model).best(np.zeros((0, 2)))[0]) == 0


@pytest.mark.parametrize(("n", "spread"), [(5, 1e-4), (300, 60.0), (1200, 1e-4), (1200, 1.0), (1500, 15.0)])
def test_gradient_is_close_to_that_of_all_pairs(n, spread):
    r = np.random.default_rng(n)
    y = r.normal(size=(n, 2)) * spread
    i, j, p = affinities(r.normal(size=(n, 5)), min((n - 1) / 3, 10))
    assert p.sum() == pytest.approx(1)
    whole = np.zeros((n, n))
    whole[i, j] = p
    assert np.allclose(whole, whole.T)
    t = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
    np.fill_diagonal(t, 0)
    pull = (whole - t / t.sum()) * t
    exact = 4 * (pull.sum(axis=1)[:, None] * y - pull @ y)
    assert np.abs(gradient(y, i, j, p) - exact).max() <= 0.01 * np.abs(exact).max()


def test_tsne_keeps_planted_groups_apart():
    r = np.random.default_rng(9)
    group = np.repeat(np.arange(4), 500)
    y = tsne(r.normal(size=(2000, 6)) + 12 * np.eye(6)[group], steps=300)
    centers = np.stack([y[group == g].mean(axis=0) for g in range(4)])
    assert (((y[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1) == group).mean() > 0.99
