"""Ridge logistic regression by Newton steps, small enough for the driver."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Linear(NamedTuple):
    """A logistic model on standardised columns, with Platt's calibration of its score."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weight + self.bias) + self.shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12, weight: np.ndarray | None = None, toward: float = 0.0) -> Linear:
    """Logistic regression by Newton steps, its coefficients drawn to ``toward``; rows count by their weight.

    A constant where only one class is present.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
    base = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    if len(y) == 0 or y.min() == y.max():
        return Linear(np.zeros(x.shape[1]), base)
    r = np.ones(len(y)) if weight is None else weight
    a = np.hstack([x, np.ones((len(x), 1))])
    aim = np.full(a.shape[1], toward)
    aim[-1] = base
    ridge = np.full(a.shape[1], l2)
    ridge[-1] = 1e-6

    def cost(w: np.ndarray) -> float:
        z = a @ w
        return float((r * (np.logaddexp(0, z) - y * z)).sum() + (ridge * (w - aim) ** 2).sum() / 2)

    w = np.zeros(a.shape[1])
    w[-1] = base
    now = cost(w)
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (r * (p - y)) + ridge * (w - aim)
        h = (a * (r * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        new = cost(w - step)
        while new > now and np.abs(step).max() > 1e-6:  # a full step may overshoot where classes are far apart
            step = step / 2
            new = cost(w - step)
        w, now = w - step, min(new, now)
        if np.abs(step).max() < 1e-4:
            break
    return Linear(w[:-1], float(w[-1]))


def calibrated(m: Linear, x: np.ndarray, y: np.ndarray) -> Linear:
    """m with Platt's scale fitted on rows that m has not seen; unchanged where these are few or of one class."""
    if len(y) < 20 or y.min() == y.max():
        return m
    z = m.score(x)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    c = fit(z[:, None], target, l2=1e-3)
    return Linear(m.weight, m.bias, max(float(c.weight[0]), 1e-3), c.bias)
