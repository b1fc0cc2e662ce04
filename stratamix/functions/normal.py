"""Numeric kernels on model-sized input: crossings of densities, one-dimensional EM. numpy only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


def pdf(x: float, mean: float, sd: float) -> float:
    return math.exp(-0.5 * ((x - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))


def crossing(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-4) -> float:
    """Bisection for f = 0; it ends as soon as |f| or the half interval is below the tolerance.

    The tolerance on f is part of the result's definition: for well separated modes the first midpoint is it.
    """
    while True:
        mid = (low + high) / 2
        value = f(mid)
        if abs(value) < tolerance:
            return mid
        if high - mid < tolerance:
            return high
        if mid - low < tolerance:
            return low
        rising = 1 if f(high) >= f(low) else -1
        if rising * value < 0:
            low = mid
        else:
            high = mid


def cutoff(p1: float, m1: float, s1: float, p2: float, m2: float, s2: float, tolerance: float = 1e-4) -> float:
    """Where two weighted normal densities cross between their means, or up to one deviation beyond if not there."""

    def f(x: float) -> float:
        return p1 * pdf(x, m1, s1) - p2 * pdf(x, m2, s2)

    at = crossing(f, m1, m2, tolerance)
    if abs(at - m1) < tolerance:
        at = crossing(f, m1 - s1, m1, tolerance)
    if abs(at - m2) < tolerance:
        at = crossing(f, m2, m2 + s2, tolerance)
    return at


@dataclass
class Fit1D:
    shares: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    loglik: float
    certainty: float  # weighted sum of ln of the largest responsibility

    def bic(self, n: float) -> float:
        return 2 * self.loglik - (3 * len(self.means) - 1) * math.log(n)

    def icl(self, n: float) -> float:
        return self.bic(n) + 2 * self.certainty


def complexity_bias(n: float, k: int) -> float:
    """What the choice by BIC takes off for k components of a sample of n."""
    return math.exp(-3.7 + 0.732 * math.log(n)) * k * math.log2(n)


def sums_1d(x: np.ndarray, w: np.ndarray, shares: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, float, float]:
    """What a step of EM needs of some points, and adds up over parts of them.

    For each component its mass, and the first and second moments about its present mean; the log-likelihood; the sum of ln of
    the largest responsibilities.
    """
    d = x[:, None] - means
    z = np.log(shares) - 0.5 * (np.log(2 * np.pi * variances) + d * d / variances)
    top = z.max(axis=1)
    total = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
    r = w[:, None] * np.exp(z - total[:, None])
    return np.stack([r.sum(axis=0), (r * d).sum(axis=0), (r * d * d).sum(axis=0)], axis=1), float(w @ total), float(w @ (top - total))


def stepped_1d(sums: np.ndarray, means: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and variances from the sums of all points; no variance is below ``floor``."""
    mass = np.maximum(sums[:, 0], 1e-300)
    shift = sums[:, 1] / mass
    return mass / mass.sum(), means + shift, np.maximum(sums[:, 2] / mass - shift * shift, floor)


def settled(loglik: float, before: float, tolerance: float = 1e-6) -> bool:
    return abs(loglik - before) < tolerance * abs(loglik)


def least_variance(variance: float) -> float:
    """No component's variance falls below this for points of a variance."""
    return max(1e-10, 1e-8 * variance)


def em_1d(x: np.ndarray, k: int, weights: np.ndarray | None = None, *, tolerance: float = 1e-6, most: int = 500, floor: float | None = None) -> Fit1D:
    """EM for k normals with their own variances, begun from k groups of equal weight in ascending order."""
    order = np.argsort(x, kind="stable")
    x = np.asarray(x, float)[order]
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)[order]
    n, mean = w.sum(), float(np.average(x, weights=w))
    floor = least_variance(float(np.average((x - mean) ** 2, weights=w))) if floor is None else floor
    group = np.minimum(((np.cumsum(w) - w / 2) / n * k).astype(int), k - 1)
    d = x - mean
    first = np.stack([np.bincount(group, w * m, k) for m in (np.ones(len(x)), d, d * d)], axis=1)
    fit = stepped_1d(first, np.full(k, mean), floor)
    before = -np.inf
    for step in range(most):
        sums, loglik, certainty = sums_1d(x, w, *fit)
        if settled(loglik, before, tolerance) or step == most - 1:
            break
        fit, before = stepped_1d(sums, fit[1], floor), loglik
    by = np.argsort(fit[1], kind="stable")
    return Fit1D(*(a[by] for a in fit), loglik, certainty)


def best_1d(fits: Sequence[Fit1D], n: float, criterion: str = "bic", prior_bic: float | None = None) -> Fit1D:
    """The fit of the best biased BIC, or of the best ICL without bias. With ``prior_bic`` the bias for k components is that times k log2 n."""
    if criterion == "icl":
        return max(fits, key=lambda f: f.icl(n))
    bias = (lambda k: complexity_bias(n, k)) if prior_bic is None else lambda k: prior_bic * k * math.log2(n)
    return max(fits, key=lambda f: f.bic(n) - bias(len(f.means)))


def choose_1d(x: np.ndarray, most: int = 3, criterion: str = "bic", weights: np.ndarray | None = None, prior_bic: float | None = None) -> Fit1D:
    """The best fit of given points with 1 to ``most`` components."""
    n = float(len(x) if weights is None else weights.sum())
    return best_1d([em_1d(x, k, weights) for k in range(1, min(most, len(np.unique(x))) + 1)], n, criterion, prior_bic)


Component = tuple[float, float, float]


def pooled(a: Component, b: Component) -> Component:
    """The share, mean and variance of two components together."""
    (p1, m1, v1), (p2, m2, v2) = a, b
    p = p1 + p2
    m = (p1 * m1 + p2 * m2) / p
    return p, m, (p1 * (v1 + (m1 - m) ** 2) + p2 * (v2 + (m2 - m) ** 2)) / p


def merge_cost(a: Component, b: Component) -> float:
    """A bound on how far, in nats, the mixture moves from itself (Kullback and Leibler's divergence) if two components become one."""
    p, _, v = pooled(a, b)
    return 0.5 * (p * math.log(v) - a[0] * math.log(a[2]) - b[0] * math.log(b[2]))


def reduced(components: Sequence[Component], most: float) -> list[Component]:
    """Components after the cheapest pair has become one, again and again, as long as that costs at most ``most``. The first of equal pairs counts."""
    out = list(components)
    while len(out) > 1:
        cost, i, j = min((merge_cost(out[i], out[j]), i, j) for i in range(len(out)) for j in range(i + 1, len(out)))
        if cost > most:
            break
        both = pooled(out[i], out[j])
        out = [c for k, c in enumerate(out) if k not in (i, j)] + [both]
        out.sort(key=lambda c: c[1])
    return out


def with_negative(fit: Fit1D, low: tuple[float, float, float | None], high: float) -> Fit1D:
    """A fit of ``high`` positive values, with one component more in front for the negative ones: their number, mean and sample variance."""
    n, mean, variance = low
    share = n / (n + high)
    variance = max(variance, 1e-10) if n > 1 and variance is not None else float(fit.variances.min())
    return Fit1D(np.r_[share, fit.shares * (1 - share)], np.r_[mean, fit.means], np.r_[variance, fit.variances], fit.loglik, fit.certainty)


def kde_bandwidth(n: float, sd: float) -> float:
    """Normal-scale bandwidth of a Gaussian kernel."""
    return (1 / (4 * math.pi)) ** 0.1 * (243 / (35 * n)) ** 0.2 * sd


def log_normal(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log density of rows of x under a multivariate normal."""
    root = np.linalg.cholesky(cov)
    z = np.linalg.solve(root, (x - mean).T)
    return -0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * len(mean) * math.log(2 * math.pi)
