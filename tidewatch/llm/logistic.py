"""A logistic curve over a few features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Curve:
    """A logistic curve over features that are centred, scaled and kept within ``reach`` deviations."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float
    reach: float = 5.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -self.reach, self.reach)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scaled(x) @ self.weights + self.constant)


def constant(features: int, label: int) -> Curve:
    """The curve of a single label."""
    zero = np.zeros(features)
    return Curve(zero, zero, zero, 10.0 if label else -10.0)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> Curve:
    """Newton's method with a ridge on all but the constant. A feature that does not vary is left out."""
    weight = weight / weight.sum()
    spread = x.std(axis=0)
    curve = Curve(x.mean(axis=0), np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0.0), np.zeros(x.shape[1]), 0.0)
    x = np.column_stack([curve.scaled(x), np.ones(len(x))])
    w, hold = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-9)
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + hold * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    curve.weights, curve.constant = w[:-1], float(w[-1])
    return curve
