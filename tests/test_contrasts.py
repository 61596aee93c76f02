"""Group contrasts against plain versions: exact enumeration for any arm size, sampled labels beyond."""

import itertools
import math

import numpy as np

from rankloom.operators import replicates as R
from rankloom.plans.contrast_queries import assignments, group_contrast


def test_assignments_are_all_but_the_observed_one():
    a = assignments(6, 3, 1000)
    assert a.shape == (math.comb(6, 3) - 1, 6) and (a.sum(axis=1) == 3).all() and len({tuple(r) for r in a}) == len(a) and [True] * 3 + [False] * 3 not in a.tolist()
    assert assignments(30, 15, 1000) is None and len(assignments(2, 2, 1000)) == 0


def test_contrasts_of_small_and_large_keys(spark):
    rng = np.random.default_rng(0)
    groups = {"a": (3, 4), "b": (2, 2), "c": (12, 15), "d": (1, 9), "e": (6, 3)}
    rows, plain = [], {}
    for k, (na, nb) in groups.items():
        v = np.round(rng.normal(size=na + nb) + np.r_[np.full(na, 1.0), np.zeros(nb)], 3)
        own = [(k, len(rows) + i, int(i < na), float(x)) for i, x in enumerate(v)]
        rows += own
        plain[k] = (own, v)
    rows += [("a", 900, 1, None), ("b", 901, 0, float("nan"))]
    got = {r.k: r for r in group_contrast(spark.createDataFrame(rows, "k string, i long, arm int, v double").repartition(3), "k", "i", "arm", "v", n_perm=100).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    for k, r in got.items():
        (own, v), (na, nb) = plain[k], groups[k]
        a, b = v[:na], v[na:]
        sd = np.sqrt(((na - 1) * a.var(ddof=1) + (nb - 1) * b.var(ddof=1)) / (na + nb - 2))
        wins = np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b])
        assert (r.n_a, r.n_b) == (na, nb) and np.allclose([r.delta, r.auroc, r.g], [a.mean() - b.mean(), wins, (1 - 3 / (4 * (na + nb) - 9)) * (a.mean() - b.mean()) / (sd + 1e-12)])
        if math.comb(na + nb, na) <= 100:
            ways = [c for c in itertools.combinations(range(na + nb), na) if c != tuple(range(na))]
        else:
            u = R.words("contrast", [i for _, i, *_ in own], 100)
            ways = [np.argsort(u[:, rep])[:na] for rep in range(100)]
        null = [v[list(c)].mean() - np.delete(v, list(c)).mean() for c in ways]
        assert np.isclose(r.p_perm, (1 + sum(abs(d) >= abs(a.mean() - b.mean()) - 1e-12 for d in null)) / (1 + len(null)))
