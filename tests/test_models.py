"""Matrix operators and models against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import logistic as L
from rankloom.operators import matrix as M
from rankloom.operators import metacells as C
from rankloom.operators import pca
from rankloom.operators.quantiles import exact_quantiles
from rankloom.plans import model_queries as Q
from rankloom.sources.relations import Tables


def frame(spark, x, **more):
    rows = [(*(int(v[i]) for v in more.values()), [None if np.isnan(a) else float(a) for a in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, f"{''.join(f'{k} long, ' for k in more)}x array<double>").repartition(5)


@pytest.mark.parametrize("block", [256, 4])
def test_products_equal_numpy(spark, block):
    rng = np.random.default_rng(0)
    x, k = rng.normal(size=(90, 11)), rng.integers(0, 2, 90)
    got = M.products(frame(spark, x, k=k), ["k"], 11, block=block, chunk_rows=7)
    for key, g in got.toPandas().groupby("k"):
        one = np.hstack([np.ones(((k == key).sum(), 1)), x[k == key]])
        assert np.allclose(M.assemble(g, 11, block), one.T @ one)
    one = np.hstack([np.ones((90, 1)), x])
    sums = {(r.i, r.j): r.v for r in M.entries(got, ["k"], 11, block).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    assert len(sums) == 78 and np.allclose([sums[i, j] for i in range(12) for j in range(i, 12)], (one.T @ one)[np.triu_indices(12)])


def test_tsqr_and_orthogonal_factor(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6)) @ np.diag([1e4, 1, 1, 1, 1e-3, 1e-5])
    df = frame(spark, x, k=np.zeros(120), i=np.arange(120))
    r = np.array(M.tsqr(df, ["k"], chunk_rows=9).first()["r"]).reshape(6, 6)
    assert np.allclose(r, M.triangle(x), rtol=1e-9, atol=1e-9)
    rows, factors = M.orthogonal_factor(df, ["k"])
    got = rows.toPandas().sort_values("i")
    q = np.stack(got["q"])
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-8 and np.allclose(q @ factors[0,], np.stack(got["x"]), rtol=1e-8)


def test_exact_quantiles_of_skewed_tied_and_missing_values(spark):
    rng = np.random.default_rng(2)
    groups = {0: np.exp(rng.normal(0, 12, 300)), 1: np.repeat([1.0, 2.0, 5.0], [300, 1, 7]), 2: np.array([4.0]), 3: np.r_[-1e308, 1e308, rng.normal(size=200)], 4: np.r_[np.arange(50) * 1e-12, 1e9]}
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [(0, None), (1, float("nan")), (7, None)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    for limits in ({}, {"parts": 256, "most": 40}):
        got = {r.k: (r.n, r.q) for r in exact_quantiles(df, ["k"], "v", probs, **limits).collect()}
        assert set(got) == set(groups)
        for k, g in groups.items():
            assert got[k][0] == len(g) and got[k][1] == pytest.approx(np.quantile(g, probs).tolist(), rel=1e-12)
    (row,) = exact_quantiles(df.filter("k < 3"), [], "v", [0.5]).collect()
    assert row.q[0] == pytest.approx(np.median(np.concatenate([groups[k] for k in (0, 1, 2)])))
    assert exact_quantiles(df.filter("k = 99"), ["k"], "v", [0.5]).count() == 0


def plain_pca(train, test, k):
    med = np.nanmedian(train, axis=0)
    fill = lambda m: np.where(np.isnan(m), med, m)
    mean = fill(train).mean(axis=0)
    _, s, v = np.linalg.svd(fill(train) - mean, full_matrices=False)
    return s**2 / (s**2).sum(), (fill(test) - mean) @ M.oriented(v[:k].T)


def test_pca_fold_scores_equal_the_plain_version(spark, sf_dir):
    e = Q.vectors(Tables(spark, sf_dir), missing=True).toPandas()
    x, cohort = M.stacked(e["x"]), e["cohort"].to_numpy()
    assert 0.05 < np.isnan(x).mean() < 0.15
    got = Q.pca_fold_scores(Tables(spark, sf_dir))
    got = {r.sample: [r[f"pc{k}"] for k in range(1, 6)] for r in got.collect()}
    assert len(got) == len(e)
    for fold in range(4):
        _, want = plain_pca(x[cohort != fold], x[cohort == fold], 5)
        own = np.array([got[s] for s in e["sample"][cohort == fold]])
        assert np.abs(own - want).max() < 2e-6


def test_pca_of_a_feature_never_measured_and_spectrum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    x[:, 2] = np.nan
    m = pca.fit(frame(spark, x, fold=np.zeros(40)), "fold", 2)[0]
    assert m.fill[2] == 0.5 and m.rows == 40
    share, scores = plain_pca(np.where(np.isnan(x), 0.5, x), x[:5] * 0 + 0.5, 2)
    assert np.allclose(m.share[:3], share[:3]) and np.allclose(m.scores(x[:5] * 0 + 0.5), scores)


def test_spread_of_score_equals_its_definition():
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(50, 6)), rng.normal(size=(6, 3))
    c = x - x.mean(axis=0)
    z = c @ w
    z = z / np.linalg.norm(z, axis=0)
    assert np.allclose(pca.spread_of_score(c.T @ c, w), ((z.T @ c) ** 2).sum(axis=1) / (c**2).sum())


def test_contrastive_components_equal_the_plain_eigenvectors(spark):
    rng = np.random.default_rng(5)
    t, b = rng.normal(size=(70, 5)) * [3, 1, 1, 1, 1], rng.normal(size=(40, 5)) * [1, 1, 2, 1, 1]
    df = frame(spark, np.vstack([t, b]), g=np.r_[np.ones(70), np.zeros(40)])
    for alpha, (w, v) in pca.contrastive(df, "g", 1, 0, [0.5, 2.0], 2).items():
        values, vectors = np.linalg.eigh(t.T @ t / 70 - alpha * b.T @ b / 40)
        assert np.allclose(w, values[::-1][:2]) and np.allclose(v, M.oriented(vectors[:, ::-1][:, :2]), atol=1e-8)


def gradient(m, x, y, cohort):
    own = np.isin(cohort, m.cohorts)
    x, y = x[own], y[own]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    weight = len(y) / (2 * np.array([(y == 0).sum(), (y == 1).sum()]))[y]
    r = m.c * weight * (1 / (1 + np.exp(-(m.w[0] + z @ m.w[1:]))) - y)
    return np.r_[r.sum(), z.T @ r]


def test_logistic_models_are_optimal(spark):
    """Every model of every fold meets the optimality conditions of its penalised loss on exactly its training rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(160, 7)) @ (np.eye(7) + 0.5)
    y = (rng.random(160) < 1 / (1 + np.exp(-x[:, 0] + 0.7 * x[:, 3]))).astype(int)
    cohort = rng.integers(0, 3, 160)
    df = frame(spark, x, cohort=cohort, y=y)
    blocks, models, chosen = Q.nested_cv(df, grid=(0.01, 0.3), passes=300)
    assert len(models) == 2 * 2 * 3 * 3
    for m in models:
        g = gradient(m, x, y, cohort)
        assert abs(g[0]) < 1e-3
        if m.penalty == "l2":
            assert np.abs(g[1:] + m.w[1:]).max() < 1e-3
        else:
            on = np.abs(m.w[1:]) > 1e-9
            assert np.abs(g[1:][on] + np.sign(m.w[1:][on])).max(initial=0) < 1e-3 and (np.abs(g[1:][~on]) <= 1 + 1e-3).all()
    assert min((np.abs(m.w[1:]) > 1e-10).sum() for m in models if m.penalty == "l1" and m.c == 0.01) < 7
    for r in chosen.collect():
        want = {}
        for c in (0.01, 0.3):
            s, t = [], []
            for m in models:
                if (m.penalty, m.outer, m.c) == (r.penalty, r.outer, c) and m.inner is not None:
                    raw = m.raw()
                    s.append(raw[0] + x[cohort == m.inner] @ raw[1:])
                    t.append(y[cohort == m.inner])
            s, t = np.concatenate(s), np.concatenate(t)
            want[c] = round(float(np.mean([(a > s[t == 0]).mean() + 0.5 * (a == s[t == 0]).mean() for a in s[t == 1]])), 6)
        assert r.inner_auc == max(want.values()) == want[r.c]


def test_metacells_equal_plain_lloyd_in_pieces_too(spark):
    rng = np.random.default_rng(7)
    x, grp = rng.normal(size=(260, 3)), np.r_[np.zeros(200), np.ones(45), np.full(15, 2)]
    df = frame(spark, x, grp=grp, row=np.arange(260))
    draws = {r.row: r.d for r in df.select("row", F.xxhash64(F.col("row"), F.lit(11)).alias("d")).collect()}
    for piece in (20_000, 30):
        placed, cells = C.metacells(df, "grp", "row", size=25, most=6, least=20, rounds=8, piece_rows=piece)
        got = {r.row: r.cell for r in placed.collect()}
        sizes = {(r.grp, r.cell): r.n for r in cells.collect()}
        assert set(got) == set(range(245))  # the group of 15 is under `least`
        for g, k in ((0, 6), (1, 1)):
            own = np.flatnonzero(grp == g)
            c = x[sorted(own, key=lambda i: (draws[i], i))[:k]]
            for _ in range(8):
                at = ((x[own][:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                c = np.stack([x[own][at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
            at = ((x[own][:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            assert [got[i] for i in own] == at.tolist() and [sizes[g, j] for j in range(k)] == np.bincount(at, minlength=k).tolist()


def test_residual_partners_equal_the_plain_version(spark, sf_dir):
    from rankloom.plans.vector_queries import pca_residual_correlation

    got = {r.sample: (r.partner, r.r) for r in pca_residual_correlation(Tables(spark, sf_dir)).collect()}
    e = Q.vectors(Tables(spark, sf_dir)).toPandas()
    x, ids = M.stacked(e["x"]), e["sample"].to_numpy()
    for c in range(4):
        own = ids[ids % 4 == c]
        z = x[ids % 4 == c]
        z = (z - z.mean(axis=0)) / (z.std(axis=0) + 1e-9)
        lead = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :2]
        r = z - z @ lead @ lead.T
        r -= r.mean(axis=1, keepdims=True)
        r /= np.linalg.norm(r, axis=1, keepdims=True)
        w = r @ r.T
        np.fill_diagonal(w, -9)
        for i, s in enumerate(own):
            if s % 50 == 0:
                assert got.pop(s) == (own[w[i].argmax()], pytest.approx(w[i].max(), abs=1e-5))
    assert not got


def test_baselines_give_a_line_for_every_fold(spark, sf_dir):
    got = Q.baselines(Tables(spark, sf_dir), components=3, alphas=(1.0,)).collect()
    names = {"signed score", "programs ridge", "lasso", "ridge", "unit-centred ridge", "components ridge", "contrastive ridge"}
    lines = {(r.baseline, r.fold): r for r in got}
    assert len(lines) == len(got) and {n for n, _ in lines} <= names and {"signed score", "ridge", "contrastive ridge"} <= {n for n, _ in lines}
    assert all(r.auroc is None or 0 <= r.auroc <= 1 for r in got)
    e = Q.vectors(Tables(spark, sf_dir)).filter("label > 0 AND label <= 4").toPandas()
    x, y = M.stacked(e["x"]), (e["label"] == 1).to_numpy().astype(int)
    score, cohort = x[:, :6].mean(axis=1) - x[:, 6:12].mean(axis=1), e["cohort"].to_numpy()
    for fold in range(4):
        a, b = ((cohort != fold) & (y == k) for k in (1, 0))
        sign = -1.0 if score[a].mean() - score[b].mean() < 0 else 1.0
        s, t = sign * score[cohort == fold], y[cohort == fold]
        want = np.mean([(v > s[t == 0]).mean() + 0.5 * (v == s[t == 0]).mean() for v in s[t == 1]]) if t.any() and not t.all() else None
        assert lines["signed score", fold].auroc == (pytest.approx(want, abs=1e-4) if want is not None else None)
