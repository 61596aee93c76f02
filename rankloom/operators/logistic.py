"""Penalised logistic regression over all rows, for every fold, penalty and strength at once.

One pass over the rows gives the gradients of all models: a task multiplies its blocks of rows with the matrix of all
coefficients and sums. A step minimises the quadratic bound whose curvature is a quarter of the weighted moments of the
model's training rows, so the moments are summed once per cohort and class, a model's are sums of those, and every
pass moves all models whatever the correlation of the features. The passes end when no coefficient moves by `tol`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import matrix as M
from rankloom.sources.shared import materialize


@dataclass
class Model:
    """Trained on the rows of `cohorts`; weights are in units of the training rows' standard deviations."""

    penalty: str
    c: float
    outer: object
    inner: object
    cohorts: list = field(default_factory=list)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    balance: np.ndarray | None = None  # weight of class 0, of class 1
    w: np.ndarray | None = None  # intercept first
    bound: np.ndarray | None = None
    done: bool = False

    def raw(self) -> np.ndarray:
        """Coefficients on the rows as they are, intercept first."""
        slope = self.w[1:] / self.scale
        return np.r_[self.w[0] - self.mean @ slope, slope]


def packed(rows: DataFrame, cohort: str, y: str, x: str) -> DataFrame:
    """Rows as written Arrow blocks of one cohort each: cohort, y and x as bytes."""
    kind = rows.schema[cohort].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, g in b.groupby(cohort, sort=False):
                yield pd.DataFrame({"cohort": [k], "y": [g[y].to_numpy(float).tobytes()], "x": [np.ascontiguousarray(M.stacked(g[x])).tobytes()]})

    return materialize(rows.select(cohort, y, x).mapInPandas(run, f"cohort {kind}, y binary, x binary"), "logistic-rows")


def _soft(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - t, 0)


def lasso_step(w: np.ndarray, g: np.ndarray, h: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Minimises g'd + d'Hd/2 + |w + d| (intercept free) by accelerated proximal steps; returns the new w."""
    step = 1 / max(np.linalg.eigvalsh(h)[-1], 1e-300)
    free = np.r_[0.0, np.ones(len(w) - 1)] * step
    x = z = w.copy()
    t = 1.0
    for _ in range(rounds):
        new = _soft(z - step * (g + h @ (z - w)), free)
        if np.abs(new - x).max() < 1e-10:
            return new
        if (z - new) @ (new - x) > 0:  # restart where momentum points uphill
            t = 1.0
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, z, t = new, new + (t - 1) / nt * (new - x), nt
    return x


def fit_all(blocks: DataFrame, moments: dict, models: list[Model], passes: int = 200, tol: float = 1e-5) -> list[Model]:
    """Train the models in place. blocks: packed(); moments: (cohort, class) -> moment matrix of (1, x)."""
    wide = next(iter(moments.values())).shape[0] - 1
    for m in models:
        own = {y: sum((moments[k] for k in moments if k[0] in m.cohorts and k[1] == y), np.zeros((wide + 1, wide + 1))) for y in (0, 1)}
        n = np.array([own[y][0, 0] for y in (0, 1)])
        total = own[0] + own[1]
        m.mean = total[0, 1:] / max(total[0, 0], 1)
        m.scale = np.sqrt(np.maximum(np.diag(total)[1:] / max(total[0, 0], 1) - m.mean**2, 0))
        m.scale = np.where(m.scale > 1e-12, m.scale, 1.0)
        m.balance, m.w = n.sum() / (2 * np.maximum(n, 1)), np.zeros(wide + 1)
        shift = np.eye(wide + 1)
        shift[0, 1:] = -m.mean / m.scale
        shift[1:, 1:] = np.diag(1 / m.scale)
        m.bound = 0.25 * m.c * (shift.T @ (m.balance[0] * own[0] + m.balance[1] * own[1]) @ shift) + 1e-9 * np.eye(wide + 1)
        m.done = bool((n == 0).any())
    for _ in range(passes):
        live = [m for m in models if not m.done]
        if not live:
            break
        for m, g in zip(live, _gradients(blocks, live)):
            slope = g[1:] - m.mean * g[0]
            g = m.c * np.r_[g[0], slope / m.scale]
            if m.penalty == "l1":
                new = lasso_step(m.w, g, m.bound)
            else:
                ridge = np.r_[0.0, np.ones(wide)]
                new = m.w - np.linalg.solve(m.bound + np.diag(ridge), g + ridge * m.w)
            m.done, m.w = bool(np.abs(new - m.w).max() < tol), new
    return models


def _gradients(blocks: DataFrame, models: list[Model]) -> list[np.ndarray]:
    """Sum over each model's training rows of class weight times (p - y) times (1, x)."""
    coef = np.stack([m.raw() for m in models], axis=1)
    wide = len(coef) - 1
    balance = np.stack([m.balance for m in models], axis=1)
    trains = {k: np.array([k in m.cohorts for m in models], float) for m in models for k in m.cohorts}

    def run(batches):
        total = np.zeros_like(coef)
        for b in batches:
            for k, y, x in zip(b["cohort"], b["y"], b["x"]):
                if k in trains:
                    y, x = np.frombuffer(y), np.frombuffer(x).reshape(-1, wide)
                    p = 1 / (1 + np.exp(-np.clip(x @ coef[1:] + coef[0], -500, 500)))
                    r = (p - y[:, None]) * balance[(y > 0.5).astype(int)] * trains[k]
                    total += np.vstack([r.sum(axis=0), x.T @ r])
        yield pd.DataFrame({"all": [0], "v": [total.ravel()]})

    parts = blocks.mapInPandas(run, "all int, v array<double>")
    n = blocks.rdd.getNumPartitions()
    if n > 64:
        parts = M.sum_arrays(parts, ["all"])
    total = sum(np.asarray(r["v"]) for r in parts.collect())  # models times features, once or 64 times at most
    return list(np.asarray(total).reshape(wide + 1, len(models)).T)


def moments_by_class(rows: DataFrame, cohort: str, y: str, x: str) -> dict:
    wide = M.width_of(rows, x)
    found: dict = {}
    for r in M.products(rows, [cohort, y], wide, x).collect():  # features squared for each cohort and class
        found.setdefault((r[cohort], r[y]), []).append((r["bi"], r["bj"], r["v"]))
    return {k: M.assemble(pd.DataFrame(v, columns=["bi", "bj", "v"]), wide) for k, v in found.items()}


def scored(blocks: DataFrame, models: list[Model], on: str) -> DataFrame:
    """penalty, c, outer, cohort, y, score: the logit of every row of the cohort that each model left out (its inner or its outer one)."""
    held: dict = {}
    for m in models:
        held.setdefault(getattr(m, on), []).append((m.penalty, float(m.c), m.outer, m.raw()))
    kind = blocks.schema["cohort"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, y, x in zip(b["cohort"], b["y"], b["x"]):
                for penalty, c, outer, coef in held.get(k, []):
                    x_ = np.frombuffer(x).reshape(-1, len(coef) - 1)
                    yield pd.DataFrame({"penalty": penalty, "c": c, "outer": outer, "cohort": k, "y": np.frombuffer(y).astype(int), "score": x_ @ coef[1:] + coef[0]})

    return blocks.mapInPandas(run, f"penalty string, c double, outer {kind}, cohort {kind}, y int, score double")
