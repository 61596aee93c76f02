"""Vectorised linear algebra for what SQL cannot say: each call sees one bounded group as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd


def symmetric_eigen(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, with vectors whose largest entry is positive."""
    w, v = np.linalg.eigh(gram)
    w, v = w[::-1], v[:, ::-1]
    return w, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def swept(residual: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """(what is left, medians taken out) after one sweep along an axis; a line without values gives 0."""
    seen = ~np.isnan(residual).all(axis=axis, keepdims=True)
    middle = np.nanmedian(np.where(seen, residual, 0.0), axis=axis, keepdims=True)
    return residual - middle, middle


def median_polish(table: np.ndarray, most_sweeps: int = 20, still: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """Overall, row and column effects: sweeps in turn until no median moves by more than `still` of the table's spread."""
    left, effects = np.array(table, dtype=float), [np.zeros((table.shape[0], 1)), np.zeros((1, table.shape[1]))]
    limit = still * (np.nanmax(left) - np.nanmin(left) + 1e-300)
    for k in range(2 * most_sweeps):
        left, moved = swept(left, axis=1 - k % 2)
        effects[k % 2] = effects[k % 2] + moved
        if k and np.abs(moved).max() <= limit:
            break
    level = [float(np.median(e)) for e in effects]
    return sum(level), effects[0].ravel() - level[0], effects[1].ravel() - level[1]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        grad = a.T @ (b - a @ x)
        if free.all() or grad[~free].max() <= 1e-9:
            break
        free[np.argmax(np.where(free, -np.inf, grad))] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min() > 0:
                x = z
                break
            bad = free & (z <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12
            if not free.any():
                break
    return x


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic coefficients with the intercept first, by Newton steps."""
    z = np.hstack([np.ones((len(x), 1)), x])
    pen = np.full(z.shape[1], l2)
    pen[0] = 0.0
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pen + 1e-9)
        step = np.linalg.solve(h, z.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def wide(group: pd.DataFrame, row: str, col: str, value: str) -> pd.DataFrame:
    return group.pivot(index=row, columns=col, values=value).sort_index().sort_index(axis=1)
