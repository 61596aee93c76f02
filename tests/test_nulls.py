"""Null models, enrichment, rewiring, background and polish against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import background as B
from rankloom.operators import enrichment as E
from rankloom.operators import linalg
from rankloom.operators import nulls as N
from rankloom.operators.polish import polished_levels
from rankloom.operators.rewiring import rewire


def plain_score(order, members, weights):
    run, best, at = 0.0, 0.0, None
    whole = sum(weights[f] for f in members)
    for f in order:
        run += weights[f] / whole if f in members else -1 / (len(order) - len(members))
        if abs(run) > abs(best) + 1e-12:
            best, at = run, f
    return best, at


def test_running_sums_equal_the_whole_walk():
    rng = np.random.default_rng(0)
    weights = np.abs(np.sort(rng.normal(size=60))[::-1])
    sets = E.random_sets(rng, 50, 7, 60, block=200)
    assert all(len(set(s)) == 7 for s in sets.tolist())
    got, _ = E.peaks(sets, weights, 60)
    want = [plain_score(range(60), set(s), weights)[0] for s in sets.tolist()]
    assert np.allclose(got, want)


def test_preranked_against_a_plain_version(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=80), 3)
    sets = {"top": np.argsort(-x)[:9].tolist(), "bottom": np.argsort(x)[:8].tolist(), "mixed": list(range(0, 80, 8)), "small": [1, 2], "large": list(range(60)), "unknown": [900, 901, 902, 903, 904]}
    ranked = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(99, None)], "feature long, x double")
    members = spark.createDataFrame([(k, f) for k, s in sets.items() for f in s] + [("top", sets["top"][0])], "set_id string, feature long")
    got = {r.set_id: r for r in E.preranked(ranked, members, least=5, most=50, reps=300, seed=4).collect()}
    assert set(got) == {"top", "bottom", "mixed"}
    order = sorted(range(80), key=lambda i: (-x[i], i))
    place = {f: k for k, f in enumerate(order)}
    weights = np.abs(x[order])
    draw = {r.set_id: r.d for r in members.select("set_id", F.xxhash64("set_id", F.lit(4)).alias("d")).distinct().collect()}
    nulls, nes = {}, {}
    for k in got:
        es, at = plain_score(order, set(sets[k]), np.abs(x))
        null, _ = E.peaks(E.random_sets(np.random.default_rng(draw[k] & (1 << 62) - 1), 300, len(sets[k]), 80), weights, 80)
        same = null[(null >= 0) == (es >= 0)]
        nes[k] = es / abs(same.mean())
        nulls[k] = np.round([v / abs(null[(null >= 0) == (v >= 0)].mean()) for v in null], 9)
        lead = [f for f in order if f in sets[k] and (place[f] <= place[at] if es >= 0 else place[f] > place[at])]
        assert got[k].es == pytest.approx(es) and got[k].nes == pytest.approx(nes[k]) and got[k].p == pytest.approx((np.abs(same) >= abs(es)).mean())
        assert got[k].leading_edge == ";".join(map(str, lead)) and got[k].tag == pytest.approx(len(lead) / len(sets[k])) and got[k].size == len(sets[k])
    pool = np.concatenate(list(nulls.values()))
    for k, v in nes.items():
        side, seen = pool[(pool >= 0) == (v >= 0)], [abs(w) for w in nes.values() if (w >= 0) == (v >= 0)]
        want = (np.abs(side) >= abs(round(v, 9))).mean() / np.mean([w >= abs(v) - 1e-12 for w in seen])
        assert got[k].fdr == pytest.approx(min(1.0, want))
    assert got["top"].nes > 1.5 and got["bottom"].nes < -1.5 and got["top"].p == 0


def test_rewiring_keeps_degrees_and_reaches_its_target(spark):
    rng = np.random.default_rng(2)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (260, 2)) if a != b}
    hub = {(0, k) for k in range(1, 40)}
    edges = sorted(pairs | hub)
    given = [(a, b, float(k)) if k % 2 else (b, a, float(k)) for k, (a, b) in enumerate(edges)] + [(5, 5, 1.0), (*edges[0], -1.0)]
    out, told = rewire(spark.createDataFrame(given, "a long, b long, weight double"), swap_factor=2)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(edges) == told["edges"] and all(a < b for a, b, _ in got) and len({(a, b) for a, b, _ in got}) == len(got)
    degree = lambda es: {n: sum(n in e[:2] for e in es) for n in range(60)}
    assert degree(got) == degree(edges) and sorted(w for *_, w in got) == [float(k) for k in range(len(edges))]
    assert told["swaps_done"] >= told["swaps_target"] == 2 * len(edges) and len({(a, b) for a, b, _ in got} & set(edges)) < 0.8 * len(edges)
    empty, told = rewire(out.filter("a < 0"))
    assert empty.count() == 0 and told["swaps_done"] == 0


def test_density_mode_is_within_a_bin_of_the_kernel_estimate(spark):
    rng = np.random.default_rng(3)
    arrays = {0: rng.gamma(2, 50, 400), 1: np.r_[rng.normal(10, 1, 300), rng.normal(30, 1, 50)], 2: np.full(5, 7.0)}
    df = spark.createDataFrame([(k, float(v)) for k, a in arrays.items() for v in a] + [(0, None)], "k long, v double").repartition(3)
    got = {r.k: r["mode"] for r in B.modes(df, ["k"], "v", 2048).collect()}
    for k, a in arrays.items():
        q1, q3 = np.percentile(a, [25, 75])
        scale = min(a.std(ddof=1), (q3 - q1) / 1.349) if q3 > q1 else a.std(ddof=1)
        bw = 0.9 * (scale or abs(a[0])) * len(a) ** -0.2
        grid = np.linspace(a.min() - 3 * bw, a.max() + 3 * bw, 4000)
        density = np.maximum(0, 1 - ((grid[:, None] - a[None]) / (bw * 5**0.5)) ** 2).sum(axis=1)
        near = density[np.abs(grid - got[k]).argmin()]
        assert near > 0.999 * density.max()


def test_background_adjustment_equals_the_formula(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(v)) for k in range(2) for i, v in enumerate(rng.exponential(80, 300) + rng.normal(100, 8, 300))] + [(0, 999, 20.0)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    p = {r.k: r for r in B.background_parameters(df, ["k"], "v").collect()}
    for k in range(2):
        v = np.array([r[2] for r in rows if r[0] == k])
        low = v[v < p[k].mu] - p[k].mu
        assert p[k].sigma == pytest.approx(math.sqrt((low**2).sum() / (len(low) - 1)) * math.sqrt(2)) and p[k].alpha > 0
    got = {(r.k, r.i): r.adjusted for r in B.adjust(df, ["k"], "v").collect()}
    assert len(got) == len(rows) and min(got.values()) >= -1e-9
    for k, i, v in rows[::37]:
        a = v - p[k].mu - p[k].alpha * p[k].sigma ** 2
        z = a / p[k].sigma
        want = a + p[k].sigma * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(-z / math.sqrt(2)))
        assert got[k, i] == pytest.approx(want)


def test_expected_signal_far_below_the_background_is_nearly_none():
    got = B.expected_signal(np.array([-1e6, 0.0, 1e6]), *(np.full(3, v) for v in (100.0, 5.0, 0.01)))
    assert got[0] == pytest.approx(0, abs=1e-6) and 0 < got[1] < 5 and got[2] == pytest.approx(1e6 - 100 - 0.25)


def test_rotations_equal_the_projection_by_qr(spark):
    rng = np.random.default_rng(5)
    y, arm = rng.normal(size=(30, 4)) * [1, 2, 3, 4], np.r_[np.ones(12, int), np.zeros(18, int)]
    df = spark.createDataFrame([(0, int(a), i, v.tolist()) for i, (a, v) in enumerate(zip(arm, y))], "k long, arm int, i long, x array<double>").repartition(4)
    got = {r.rep: np.array(r["shift"]) for r in N.rotation_null(df, "k", "arm", "i", reps=40, seed=9).collect()}
    assert np.allclose(got[0], y[arm == 1].mean(axis=0) - y[arm == 0].mean(axis=0))
    z = np.stack([N.draws(9, i, 40, True) for i in range(30)])
    q, _ = np.linalg.qr(np.c_[np.ones(30), arm, z[:, :1]])
    basis = np.c_[np.ones(30), arm]
    resid = y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]
    for rep in range(1, 41):
        u = z[:, rep - 1] - basis @ np.linalg.lstsq(basis, z[:, rep - 1], rcond=None)[0]
        u = u / np.linalg.norm(u)
        assert abs(u.sum()) < 1e-9 and abs(u[arm == 1].sum()) < 1e-9 and np.abs(got[rep] - u @ resid).max() < 1e-9
    assert np.abs(np.abs(q[:, 2] @ resid) - np.abs(got[1])).max() < 1e-9


def test_splits_equal_plain_effects(spark):
    rng = np.random.default_rng(6)
    y = rng.normal(size=(25, 3))
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(y)] + [(1, 90, [0.0, 0.0, 0.0])], "k long, i long, x array<double>").repartition(3)
    got = {(r.k, r.rep): r for r in N.split_null(df, "k", "i", {0: 0.4, 1: 0.5}, reps=30, seed=3).collect()}
    assert len(got) == 60 and all(got[1, r].g is None for r in range(1, 31))
    u = np.stack([N.draws(3, i, 30, False) for i in range(25)]) < 0.4
    for rep in range(1, 31):
        a, b = y[u[:, rep - 1]], y[~u[:, rep - 1]]
        if min(len(a), len(b)) >= 2:
            sd = np.sqrt((a.var(axis=0, ddof=1) * (len(a) - 1) + b.var(axis=0, ddof=1) * (len(b) - 1)) / 23)
            assert np.allclose(got[0, rep]["shift"], a.mean(axis=0) - b.mean(axis=0)) and np.allclose(got[0, rep].g, (1 - 3 / 91) * (a.mean(axis=0) - b.mean(axis=0)) / (sd + 1e-6))


def test_polish_over_tasks_equals_the_sweeps_of_one_table(spark):
    rng = np.random.default_rng(7)
    tables = {k: np.add.outer(rng.normal(size=n), [0.0, 5, 1, 2]) + (rng.random((n, 4)) < 0.1) * 9 for k, n in ((0, 41), (1, 7))}
    df = spark.createDataFrame([(k, i, v.tolist()) for k, m in tables.items() for i, v in enumerate(m)], "k long, i long, x array<double>").repartition(3)
    got = {(r.k, r.i): r.level for r in polished_levels(df, "k", "i").collect()}
    for k, m in tables.items():
        overall, rows, _ = linalg.median_polish(m)
        assert np.allclose([got[k, i] for i in range(len(m))], overall + rows, atol=1e-6)
