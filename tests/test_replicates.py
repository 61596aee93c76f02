"""Replicates in one pass and nearest rows against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from rankloom.operators import replicates as R
from rankloom.operators import statistics as T
from rankloom.operators.nearest import nearest


def frame(spark, x, key=None):
    return spark.createDataFrame([(int(key[i]) if key is not None else 0, i, v.tolist()) for i, v in enumerate(x)], "k long, i long, x array<double>").repartition(4)


def test_poisson_weights_and_subsets_equal_plain_sums(spark):
    rng = np.random.default_rng(0)
    x, key = rng.normal(size=(70, 3)), rng.integers(0, 2, 70)
    u = R.words("a", range(70), 22)
    assert u.shape == (70, 22) and 0.4 < u.mean() < 0.6
    got = {(r.k, r.rep): r for r in R.weighted_sums(frame(spark, x, key), "k", "i", "x", "a", 22, block=9).collect()}
    w = np.searchsorted(R.POISSON, u, side="right")
    assert len(got) == 44 and 0.8 < w.mean() < 1.2
    for (k, rep), r in got.items():
        own = key == k
        assert r.n == w[own, rep].sum() and np.allclose(r.s, w[own, rep] @ x[own]) and r.all_n == own.sum() and np.allclose(r.all_s, x[own].sum(axis=0))
    df = frame(spark, x)
    cut = R.cutoffs(df, "i", 25, "b", 12)
    u = R.words("b", range(70), 12)
    assert ((u <= cut).sum(axis=0) == 25).all()
    for r in R.weighted_sums(df, "k", "i", "x", "b", 12, cut).collect():
        pick = np.argsort(u[:, r.rep])[:25]
        assert r.n == 25 and np.allclose(r.s, x[pick].sum(axis=0))


def test_nearest_equals_all_pairs_with_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5))
    x[40] = x[7] * 3
    x[41] = x[7]
    x[60] = 0
    df = frame(spark, x).select(F.col("i").alias("sample"), "x")
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    for block in (1024, 4):
        got = {}
        for r in nearest(df, df.filter("sample % 7 = 0 OR sample = 60"), 3, block=block).collect():
            got.setdefault(r.i, set()).add((r.j, r.w))
        assert set(got) == set(range(0, 90, 7))
        for i, found in got.items():
            w = np.round(unit @ unit[i], 6) + 0.0
            order = [j for j in sorted(range(90), key=lambda j: (-w[j], j)) if j not in (i, 60)][:3]
            assert {j for j, _ in found} == set(order) and all(abs(w[j] - v) < 1e-9 for j, v in found)
    assert nearest(df, df.filter("sample > 1000"), 3).count() == 0


def test_bh_of_ties_nulls_and_many_bins(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(300) ** 2, 2)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(900, None)], "i long, p double").repartition(3)
    order = np.argsort(p)
    want = np.empty(300)
    want[order] = np.minimum(1, np.minimum.accumulate((p[order] * 300 / np.arange(1, 301))[::-1])[::-1])
    for parts in (1024, 7):
        got = {r.i: r.q for r in T.bh(d, "p", parts=parts).collect()}
        assert got.pop(900) is None and np.allclose([got[i] for i in range(300)], want)
