"""Small linear models, fitted on the driver on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _norm(x: np.ndarray, rounds: int = 20) -> float:
    """Largest eigenvalue of x'x / n, by power iteration."""
    v = np.ones(x.shape[1], x.dtype)
    size = 1.0
    for _ in range(rounds):
        v = x.T @ (x @ v) / len(x)
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    return size


def lasso_logistic(x: np.ndarray, y: np.ndarray, l1: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept; the intercept isn't penalised."""
    x1 = np.column_stack([x, np.ones(len(x), x.dtype)])
    step = 1 / (0.25 * _norm(x1) * 1.05 + 1e-9)
    w = np.zeros(x1.shape[1], x.dtype)
    z, t = w.copy(), 1.0
    shrink = np.full(len(w), l1 * step, x.dtype)
    shrink[-1] = 0
    for _ in range(rounds):
        v = z - step * (x1.T @ (sigmoid(x1 @ z) - y) / len(x))
        new = np.sign(v) * np.maximum(np.abs(v) - shrink, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def ridge_logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method, for few columns; the intercept isn't penalised."""
    x1 = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        grad = x1.T @ (p - y) / len(x) + penalty * w
        hess = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 / len(x) + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def linear_svm(gram: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Squared hinge loss, y in (-1, 1), classes weighted alike. Takes the products of all rows
    (with 1 added for the intercept) and returns each row's coefficient: the weights are the
    coefficients' sum of rows. With fewer rows than columns this is the cheaper way to go down
    the same gradient."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(gram.dtype)
    v, size = np.ones(len(y), gram.dtype), 1.0
    root = np.sqrt(weight)
    for _ in range(20):
        v = root * (gram @ (root * v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1 / (2 * size * 1.05 + l2)
    a = np.zeros(len(y), gram.dtype)
    z, t = a.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (gram @ z))
        new = z - step * (-2 * weight * y * slack + l2 * z)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - a)
        a, t = new, t_new
    return a
