"""Linear support vector machines on a bounded sample (dual coordinate
descent on the squared hinge loss)."""

from __future__ import annotations

import numpy as np


def train(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of a separator of the rows of ``x`` (float32) by ``y`` (+1 or
    -1); the last weight is the bias.  Classes weigh alike."""
    n = len(y)
    share = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * cost * share)
    weights = np.zeros(x.shape[1] + 1, np.float64)
    alpha = np.zeros(n)
    norms = (x.astype(np.float64) ** 2).sum(1) + 1 + slack
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(n).tolist():
            gradient = y[i] * (x[i] @ weights[:-1] + weights[-1]) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norms[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[:-1] += step * x[i]
                weights[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights
