"""Nearest rows by cosine, for a set of query rows against all rows, as products of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import matrix as M
from rankloom.sources.shared import materialize


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, np.nan)


def _blocks(rows: DataFrame, row: str, x: str, size: int) -> DataFrame:
    """ids and unit vectors of runs of rows, as bytes."""

    def run(batches):
        for b in batches:
            for k in range(0, len(b), size):
                part = b.iloc[k : k + size]
                yield pd.DataFrame({"ids": [part[row].to_numpy("<i8").tobytes()], "m": [np.ascontiguousarray(_unit(M.stacked(part[x]))).tobytes()]})

    return rows.select(row, x).mapInPandas(run, "ids binary, m binary")


def nearest(rows: DataFrame, queries: DataFrame, k: int, row: str = "sample", x: str = "x", block: int = 1024, places: int = 6, at_once: int = 1024) -> DataFrame:
    """i, j, w: the k rows j of largest cosine w (rounded) for every query i other than itself; ties to the smaller j.

    Query blocks are numbered, row blocks are dealt to every one of them by an equi-join on that number, a task multiplies
    two blocks at a time, `at_once` queries of them a step, and keeps k partners a query, and the partial lists are cut to k
    per query. A query block travels with every row block it meets, so its bytes bound what a batch of pairs holds. A
    vector of length zero has no cosine.
    """
    asked = materialize(_blocks(queries, row, x, block).withColumn("q", F.monotonically_increasing_id()), "nearest-queries").withColumnsRenamed({"ids": "qi", "m": "qm"})
    numbers = [r["q"] for r in asked.select("q").collect()]  # one a query block
    if not numbers:
        return rows.sparkSession.createDataFrame([], "i long, j long, w double")
    met = _blocks(rows, row, x, block).withColumn("q", F.explode(F.array(*map(F.lit, numbers)))).join(asked, "q")

    def multiply(batches):
        for b in batches:
            for ids, m, qi, qm in zip(b["ids"], b["m"], b["qi"], b["qm"]):
                ids, qi, m = np.frombuffer(ids, "<i8"), np.frombuffer(qi, "<i8"), np.frombuffer(m).reshape(len(np.frombuffer(ids, "<i8")), -1)
                order = np.argsort(ids, kind="stable")
                ids, m = ids[order], m[order]
                asked = np.frombuffer(qm).reshape(len(qi), -1)
                for s in range(0, len(qi), at_once):
                    own = qi[s : s + at_once]
                    w = np.round(asked[s : s + at_once] @ m.T, places) + 0.0
                    w[(own[:, None] == ids[None, :]) | np.isnan(w)] = -np.inf
                    best = np.argsort(-w, axis=1, kind="stable")[:, :k]
                    top = np.take_along_axis(w, best, axis=1)
                    keep = np.isfinite(top)
                    yield pd.DataFrame({"i": np.repeat(own, best.shape[1])[keep.ravel()], "j": ids[best][keep], "w": top[keep]})

    part = met.mapInPandas(multiply, "i long, j long, w double")
    best = part.groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("d"), "j", "w"))), 1, k).alias("b"))  # k for each row block
    return best.select("i", F.explode("b").alias("b")).select("i", "b.j", "b.w")
