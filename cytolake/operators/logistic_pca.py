"""Sparse logistic principal components of a binary matrix with missing entries.

The matrix is one block of bounded size (cells by chosen regions), so the
iteration runs in one place; choose regions first (``matrix.top_variable``).
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def loss(x: np.ndarray, theta: np.ndarray) -> float:
    """Negative log likelihood over the entries that are not missing."""
    seen = ~np.isnan(x)
    q = 2 * x[seen] - 1
    return float(-np.log(sigmoid(q * theta[seen])).sum())


def fit(x: np.ndarray, k: int, penalty: float = 0.0, rounds: int = 200, tolerance: float = 1e-6, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets mu (d), orthonormal scores a (n x k) and sparse loadings b (d x k) with x ~ sigmoid(mu + a b').

    Each round majorises the loss by a quadratic (a missing entry stands for
    its fitted value), solves the scores by a rotation and the loadings by
    soft thresholding.
    """
    n, d = x.shape
    rng = np.random.default_rng(seed)
    share = np.nan_to_num(np.nanmean(x, axis=0), nan=0.5)
    mu = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    a = np.linalg.qr(rng.normal(size=(n, k)))[0]
    b = np.zeros((d, k))
    before = np.inf
    for _ in range(rounds):
        theta = mu + a @ b.T
        step = np.where(np.isnan(x), 0.0, 4 * (np.nan_to_num(x) - sigmoid(theta)))
        z = theta + step
        mu = (z - a @ b.T).mean(axis=0)
        centred = z - mu
        if b.any():
            u, _, vt = np.linalg.svd(centred @ b, full_matrices=False)
            a = u @ vt
        else:
            a = np.linalg.svd(centred, full_matrices=False)[0][:, :k]
        raw = centred.T @ a
        b = np.sign(raw) * np.maximum(np.abs(raw) - 4 * penalty, 0)
        now = loss(x, mu + a @ b.T) + penalty * np.abs(b).sum()
        if before - now < tolerance * max(1.0, abs(now)):
            break
        before = now
    return mu, a, b


def choose_penalty(x: np.ndarray, k: int, penalties: tuple[float, ...]) -> tuple[float, list[float]]:
    """The penalty with the smallest Bayesian information criterion, and all criteria."""
    seen = int((~np.isnan(x)).sum())
    out = []
    for p in penalties:
        mu, a, b = fit(x, k, p)
        out.append(2 * loss(x, mu + a @ b.T) + np.log(max(seen, 2)) * int((b != 0).sum()))
    return penalties[int(np.argmin(out))], out
