"""Logistic regression on a bounded, labelled sample."""

from __future__ import annotations

import numpy as np

#: A step's length at most; where the kinds can be told apart without error, full steps would run away.
LONGEST_STEP = 8.0


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50, balanced: bool = True) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood, the classes weighted alike if `balanced`; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if balanced else np.ones(len(y))
    penalty = ridge * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (weight * (y - p)) - penalty * w)
        length = np.sqrt((step**2).sum())
        w += step * min(1.0, LONGEST_STEP / max(length, 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
