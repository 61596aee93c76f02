"""Null effects of whole feature vectors, all replicates in one pass over the rows.

A row draws its numbers for all replicates from a counter generator keyed by the row, so a retried task draws the same,
and a task multiplies its draws with its values: what it emits has the size replicates times features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import matrix as M


def draws(seed: int, row: int, reps: int, normal: bool) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=[seed, row & (1 << 64) - 1]))
    return rng.standard_normal(reps) if normal else rng.random(reps)


def _effects(n1, n0, s1, s0, q1, q0):
    """(corrected standardised effect, mean difference) from counts, sums and sums of squares of two arms."""
    with np.errstate(all="ignore"):
        n = n1 + n0
        shift = s1 / n1 - s0 / n0
        inner = (q1 - s1 * s1 / n1) + (q0 - s0 * s0 / n0)
        sd = np.sqrt(np.maximum(inner / (n - 2), 0))
        return (1 - 3 / (4 * n - 9)) * shift / (sd + 1e-6), shift


def _sums(rows: DataFrame, keys: list[str], row: str, x: str, make) -> DataFrame:
    """keys, v: make(draw matrix, value matrix) of blocks of rows, added up."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        total: dict = {}
        for b in batches:
            for key, g in b.groupby(keys, sort=False):
                for k in range(0, len(g), 256):
                    part = g.iloc[k : k + 256]
                    total[key] = total.get(key, 0) + make(key, part[row].to_numpy(), M.stacked(part[x]))
        yield pd.DataFrame([(*k, v) for k, v in total.items()], columns=[*keys, "v"])

    return M.sum_arrays(rows.select(*keys, row, x).mapInPandas(run, f"{kinds}, v array<double>"), keys)


def split_null(rows: DataFrame, key: str, row: str, share: dict, x: str = "x", reps: int = 1000, seed: int = 1) -> DataFrame:
    """key, rep (1..reps), g, shift: effects of random splits of each key's rows; share: key -> chance to be in the first arm.

    On all rows this is the permutation of labels, on the controls the control split. Arm sizes are those of the draws
    (binomial); a replicate with fewer than two rows in an arm has null effects.
    """
    wide = M.width_of(rows, x)

    def make(key, ids, y):
        a = np.stack([draws(seed, int(i), reps, False) for i in ids]) < share[key[0]]
        one, sq = a.astype(float), y * y
        return np.concatenate([one.sum(axis=0), (one.T @ y).ravel(), (one.T @ sq).ravel(), [len(y)], y.sum(axis=0), sq.sum(axis=0)])

    def finish(b: pd.DataFrame) -> pd.DataFrame:
        v = np.asarray(b["v"].iloc[0])
        n1, rest = v[:reps, None], v[reps:]
        s1, q1 = rest[: reps * wide].reshape(reps, wide), rest[reps * wide : 2 * reps * wide].reshape(reps, wide)
        n, t, q = rest[2 * reps * wide], rest[2 * reps * wide + 1 : 2 * reps * wide + 1 + wide], rest[-wide:]
        g, shift = _effects(n1, n - n1, s1, t - s1, q1, q - q1)
        good = ((n1 >= 2) & (n - n1 >= 2)).ravel()
        return pd.DataFrame({key: b[key].iloc[0], "rep": np.arange(1, reps + 1), "g": [e if ok else None for e, ok in zip(g, good)], "shift": [e if ok else None for e, ok in zip(shift, good)]})

    kind = rows.schema[key].dataType.simpleString()
    return _sums(rows, [key], row, x, make).groupBy(key).applyInPandas(finish, f"{key} {kind}, rep int, g array<double>, shift array<double>")


def rotation_null(rows: DataFrame, key: str, arm: str, row: str, x: str = "x", reps: int = 1000, seed: int = 1) -> DataFrame:
    """key, rep (0 is the observed effect), g, shift: residuals of each arm along random unit directions.

    A direction is a vector of keyed Gaussians over the key's rows, made orthogonal to both arms' indicators (the arm
    means are taken out, which is the projection that a QR with those two columns gives) and scaled to length one.
    """
    wide = M.width_of(rows, x)

    def make(key, ids, y):
        z = np.stack([draws(seed, int(i), reps, True) for i in ids])
        return np.concatenate([[len(y)], z.sum(axis=0), (z * z).sum(axis=0), y.sum(axis=0), (y * y).sum(axis=0), (z.T @ y).ravel()])

    def finish(b: pd.DataFrame) -> pd.DataFrame:
        cross, length, inner, n, means = np.zeros((reps, wide)), np.zeros(reps), np.zeros(wide), 0, {}
        for which, v in zip(b[arm], b["v"]):
            v = np.asarray(v)
            m, z, zz, y, yy = v[0], v[1 : reps + 1], v[reps + 1 : 2 * reps + 1], v[2 * reps + 1 : 2 * reps + 1 + wide], v[2 * reps + 1 + wide : 2 * reps + 1 + 2 * wide]
            cross += v[2 * reps + 1 + 2 * wide :].reshape(reps, wide) - np.outer(z, y) / m
            length += zz - z * z / m
            inner += yy - y * y / m
            n, means[which] = n + m, (m, y / m)
        if len(means) < 2 or n < 4:
            return pd.DataFrame({key: [], "rep": [], "g": [], "shift": []})
        sd = np.sqrt(np.maximum(inner / (n - 2), 0))
        turned = cross / np.sqrt(length)[:, None]
        seen = means[1][1] - means[0][1]
        return pd.DataFrame({key: b[key].iloc[0], "rep": np.arange(reps + 1), "g": [(1 - 3 / (4 * n - 9)) * seen / (sd + 1e-6), *(turned / (sd + 1e-6))], "shift": [seen, *turned]})

    kind = rows.schema[key].dataType.simpleString()
    return _sums(rows, [key, arm], row, x, make).groupBy(key).applyInPandas(finish, f"{key} {kind}, rep int, g array<double>, shift array<double>")
