"""Logistic regression on sets of feature ids, in NumPy."""

from __future__ import annotations

import numpy as np


class Rows:
    """Binary features by row (``cols`` of row i are cols[starts[i]:starts[i+1]]) plus dense ones."""

    def __init__(self, cols: list[np.ndarray], width: int, dense: np.ndarray | None = None):
        self.width = width
        self.cols = np.concatenate([np.empty(0, np.int64), *cols]).astype(np.int64)
        self.counts = np.array([len(c) for c in cols], np.int64)
        self.row = np.repeat(np.arange(len(cols)), self.counts)
        self.dense = np.zeros((len(cols), 0)) if dense is None else dense

    def take(self, keep: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        place = np.cumsum(keep) - 1
        on = keep[self.row]
        out.width, out.cols, out.row = self.width, self.cols[on], place[self.row[on]]
        out.counts, out.dense = self.counts[keep], self.dense[keep]
        return out

    def with_dense(self, more: np.ndarray) -> Rows:
        out = self.take(np.ones(len(self.counts), bool))
        out.dense = np.concatenate([self.dense, more[:, None]], 1)
        return out

    def score(self, w: np.ndarray, v: np.ndarray, b: float) -> np.ndarray:
        sums = np.bincount(self.row, weights=w[self.cols], minlength=len(self.counts))
        return sums + self.dense @ v + b

    def back(self, err: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        grad = np.bincount(self.cols, weights=err[self.row], minlength=self.width)
        return grad, self.dense.T @ err, float(err.sum())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: Rows, y: np.ndarray, ridge: float = 1.0, steps: int = 150, rate: float = 0.08):
    """Weights of binary features, of dense features, and the intercept (Adam, full batch).

    The penalty is ``ridge`` against the summed loss, so few rows are shrunk more.
    """
    n = max(len(y), 1)
    l2 = ridge / n
    share = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
    theta = np.zeros(x.width + x.dense.shape[1] + 1)
    theta[-1] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return theta[: x.width], theta[x.width : -1], float(theta[-1])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, v, b = theta[: x.width], theta[x.width : -1], theta[-1]
        gw, gv, gb = x.back((sigmoid(x.score(w, v, b)) - y) / n)
        g = np.concatenate([gw + l2 * w, gv + l2 * v, [gb]])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return theta[: x.width], theta[x.width : -1], float(theta[-1])
