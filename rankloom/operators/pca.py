"""Principal components fitted on training folds and applied to held-out rows; contrastive components of two groups.

A model has the size of the features, never of the rows, so it is what travels: medians, means and loadings go to the
tasks in the closure that applies them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import matrix as M
from rankloom.operators.quantiles import exact_quantiles


@dataclass
class Components:
    """One fold's model: fill (per feature), mean, share of variance of each component, loadings (features x components)."""

    fill: np.ndarray
    mean: np.ndarray
    share: np.ndarray
    loadings: np.ndarray
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill, x) - self.mean) @ self.loadings


def medians(rows: DataFrame, fold: str, x: str = "x", empty: float = 0.5) -> dict:
    """Median of every feature per fold over its non-missing values; a feature that a fold never measured takes `empty`."""
    long = rows.select(fold, F.posexplode(x).alias("_f", "_value"))
    found = exact_quantiles(long, [fold, "_f"], "_value", [0.5]).select(fold, "_f", F.col("q")[0].alias("m"))
    out: dict = {}
    for r in found.collect():  # folds times features
        out.setdefault(r[fold], {})[r["_f"]] = r["m"]
    wide = M.width_of(rows, x)
    return {k: np.array([v.get(i, empty) for i in range(wide)]) for k, v in out.items()}


def filled(rows: DataFrame, fill: dict, fold: str, x: str = "x") -> DataFrame:
    """rows with the missing values of x replaced by their fold's; rows of a fold without a model are left out."""

    def run(batches):
        for b in batches:
            b = b[b[fold].isin(fill)]
            if len(b):
                yield b.assign(**{x: [np.where(np.isnan(m), fill[k], m) for k, m in zip(b[fold], M.stacked(b[x]))]})

    return rows.mapInPandas(run, rows.schema)


def fit(train: DataFrame, fold: str, components: int, x: str = "x", missing: bool = True) -> dict[object, Components]:
    """A model per fold from its training rows (fold, x): medians for missing values, mean and leading components.

    Two passes for the medians and one for the moments; eigenvectors are taken where a fold's blocks meet.
    """
    wide = M.width_of(train, x)
    fill = medians(train, fold, x) if missing else {}
    rows = filled(train.select(fold, x), fill, fold, x) if missing else train.select(fold, x)
    blocks = M.products(rows, [fold], wide, x)
    kind = train.schema[fold].dataType.simpleString()

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        s = M.assemble(g, wide)
        n, mean = s[0, 0], s[0, 1:] / s[0, 0]
        cov = s[1:, 1:] - n * np.outer(mean, mean)
        w, v = np.linalg.eigh(cov)
        lead = M.oriented(v[:, ::-1][:, :components])
        share = np.clip(w[::-1], 0, None) / max(np.trace(cov), 1e-300)
        return pd.DataFrame({fold: g[fold].iloc[:1], "n": [int(n)], "mean": [mean], "share": [share], "loadings": [lead.ravel()]})

    models = blocks.groupBy(fold).applyInPandas(solve, f"{fold} {kind}, n long, mean array<double>, share array<double>, loadings array<double>").collect()  # one a fold
    return {r[fold]: Components(fill.get(r[fold], np.zeros(wide)), np.array(r["mean"]), np.array(r["share"]), np.array(r["loadings"]).reshape(wide, -1), r["n"]) for r in models}


def transform(rows: DataFrame, models: dict, fold: str, x: str = "x", out: str = "pc") -> DataFrame:
    """rows with their scores under their fold's model, missing values filled by that model's medians."""

    def run(batches):
        for b in batches:
            scores = [None] * len(b)
            for k, at in b.groupby(fold, sort=False).indices.items():
                if k in models:
                    for i, s in zip(at, models[k].scores(M.stacked(b[x].iloc[at]))):
                        scores[i] = s
            yield b.assign(**{out: scores})

    return rows.mapInPandas(run, M.with_vector(rows.schema, out))


def spread_of_score(cov: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Share of total variance along each score x @ weights (columns), from the covariance alone."""
    along = cov @ weights
    return (along**2).sum(axis=0) / np.maximum((weights * along).sum(axis=0), 1e-300) / np.trace(cov)


def contrastive(rows: DataFrame, group: str, target, background, alphas: list[float], components: int, x: str = "x") -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """alpha -> (eigenvalues, loadings) of cov(target) - alpha cov(background), from centred rows.

    Each group is folded to its triangular factor over the partitions (no Gram matrix), and only the two factors come
    together: with the QR of their stack, the difference is a small symmetric problem in an orthonormal basis.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).agg(F.count(F.lit(1))).collect()}
    r = {row[group]: np.array(row["r"]) for row in M.tsqr(rows, [group], x).collect()}  # one factor a group
    wide = int(round(len(r[target]) ** 0.5))
    t, b = (r[k].reshape(wide, wide) for k in (target, background))
    out = {}
    for alpha in alphas:
        stack = np.vstack([t / counts[target] ** 0.5, b * (alpha / counts[background]) ** 0.5])
        q, _ = np.linalg.qr(stack.T)
        core = stack @ q
        w, v = np.linalg.eigh(core.T @ (np.r_[np.ones(wide), -np.ones(wide)][:, None] * core))
        best = np.argsort(-w)[:components]
        out[alpha] = w[best], M.oriented(q @ v[:, best])
    return out
