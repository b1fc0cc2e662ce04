"""A ball tree over mixture components: for each row the densest component, without the densities of all. numpy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .normal import log_normal

#: Components of a leaf, and what is added to bounds for rounding, relative to them.
LEAF, SLACK = 4, 1e-9


@dataclass
class Ball:
    """Components whose means lie in a ball: the most that any of them may reach at a distance from it falls with that distance."""

    members: np.ndarray
    center: np.ndarray
    radius: float
    height: float  # the largest log of share and density at a mean
    widest: float  # the largest eigenvalue of their covariances
    parts: list[Ball] = field(default_factory=list)

    def bound(self, x: np.ndarray) -> np.ndarray:
        """An upper bound of ln share + ln density of the members: x is at least as many of the widest deviations away as this."""
        away = np.maximum(np.sqrt(((x - self.center) ** 2).sum(axis=1)) - self.radius, 0.0)
        b = self.height - 0.5 * away * away / self.widest
        return b + SLACK * (1 + np.abs(b))

    def leaves(self) -> list[Ball]:
        return [leaf for p in self.parts for leaf in p.leaves()] if self.parts else [self]


class BallTree:
    """Shares, means and covariances, as balls that are halved along the widest direction of their means."""

    def __init__(self, pro: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> None:
        self.log_pro, self.mean, self.cov = np.log(np.maximum(pro, 1e-300)), mean, cov
        half = 0.5 * (np.linalg.slogdet(cov)[1] + mean.shape[1] * np.log(2 * np.pi))
        self._height, self._widest = self.log_pro - half, np.linalg.eigvalsh(cov)[:, -1]
        self.root = self._ball(np.arange(len(pro)))

    def _ball(self, members: np.ndarray) -> Ball:
        m = self.mean[members]
        center = m.mean(axis=0)
        ball = Ball(members, center, float(np.sqrt(((m - center) ** 2).sum(axis=1)).max()), float(self._height[members].max()), float(self._widest[members].max()))
        if len(members) > LEAF:
            order = members[np.argsort(m[:, np.ptp(m, axis=0).argmax()], kind="stable")]
            ball.parts = [self._ball(np.sort(part)) for part in np.array_split(order, 2)]
        return ball

    def best(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """The first component of the largest share times density for each row, and how many densities that took."""
        best, which, count = np.full(len(x), -np.inf), np.full(len(x), len(self.mean)), 0

        def judge(ball: Ball, rows: np.ndarray) -> None:
            nonlocal count
            for k in ball.members:
                z = self.log_pro[k] + log_normal(x[rows], self.mean[k], self.cov[k])
                better = (z > best[rows]) | (z == best[rows]) & (k < which[rows])
                best[rows[better]], which[rows[better]] = z[better], k
                count += len(rows)

        # each row begins in the leaf that promises most
        leaves = self.root.leaves()
        first = np.stack([leaf.bound(x) for leaf in leaves], axis=1).argmax(axis=1)
        for i, leaf in enumerate(leaves):
            if len(rows := np.flatnonzero(first == i)):
                judge(leaf, rows)
        number = {id(leaf): i for i, leaf in enumerate(leaves)}

        def descend(ball: Ball, rows: np.ndarray) -> None:
            rows = rows[ball.bound(x[rows]) >= best[rows]]
            if not ball.parts:
                rows = rows[first[rows] != number[id(ball)]]
            if len(rows):
                for part in ball.parts:
                    descend(part, rows)
                if not ball.parts:
                    judge(ball, rows)

        descend(self.root, np.arange(len(x)))
        return which, count
