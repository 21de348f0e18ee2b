"""Cumulative-link (proportional odds) regression over sparse binary features.

P(grade <= k) = sigmoid(t_k - x.w): one weight a feature shared by all thresholds, which stay in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of sorted or unsorted feature numbers, all of value one."""

    starts: np.ndarray
    columns: np.ndarray

    @classmethod
    def of(cls, rows: list[list[int]]) -> Sparse:
        sizes = np.array([len(r) for r in rows])
        return cls(np.concatenate(([0], np.cumsum(sizes))), np.array([c for r in rows for c in r], np.int64))

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(w[self.columns])))
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(g, np.diff(self.starts)), n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 - _sigmoid(self.thresholds[None, :] - np.asarray(score)[:, None])

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Expected grade."""
        return self.grades(score).sum(1)


def fit(x: Sparse, y: np.ndarray, features: int, grades: int, ridge: float = 1e-4, lasso: float = 2e-4, rounds: int = 300, rate: float = 0.05) -> Ordinal:
    """Penalised maximum likelihood by Adam steps; after each, ``lasso`` draws the weights towards zero.

    y: grades from 0 to ``grades`` - 1. Thresholds are a first one and positive gaps, so they can't cross.
    """
    n, cuts_n = len(y), grades - 1
    theta = np.zeros(features + cuts_n)
    theta[features] = 1.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, t0, gaps = theta[:features], theta[features], np.exp(theta[features + 1 :])
        cuts = t0 + np.concatenate(([0.0], np.cumsum(gaps)))
        score = x.dot(w)
        upper = np.where(y < cuts_n, _sigmoid(cuts[np.minimum(y, cuts_n - 1)] - score), 1.0)
        lower = np.where(y > 0, _sigmoid(cuts[np.maximum(y - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
        by_cut = np.bincount(y[y < cuts_n], -du[y < cuts_n], cuts_n) + np.bincount(y[y > 0] - 1, dl[y > 0], cuts_n)
        by_gap = [by_cut[k + 1 :].sum() * gaps[k] for k in range(cuts_n - 1)]
        g = np.concatenate((x.back(du - dl, features) + ridge * w, [by_cut.sum()], by_gap))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        own = rate * (1 - step / (rounds + 1))
        theta = theta - own * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w = theta[:features]
        theta[:features] = np.sign(w) * np.maximum(np.abs(w) - own * lasso * 10, 0)
    t0, gaps = theta[features], np.exp(theta[features + 1 :])
    return Ordinal(theta[:features], t0 + np.concatenate(([0.0], np.cumsum(gaps))))
