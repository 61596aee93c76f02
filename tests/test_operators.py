"""Operators on small relations with ties, gaps and single classes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import linalg, ranks, statistics, tails
from rankloom.operators.components import connected_components
from rankloom.operators.ordering import global_rank


def test_average_rank_ties_and_single(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, value double")
    got = sorted((r.k, r.value, r.rk) for r in ranks.average_rank(d, "k").collect())
    assert got == [("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 2.0, 3.0), ("b", 5.0, 1.0)]
    assert {r.r for r in ranks.percentile_rank(d.filter("k = 'b'"), "k").collect()} == {None}


def test_auroc_single_class_is_null(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 1.0), ("a", 0, 0.0), ("b", 1, 3.0)], "k string, y int, score double")
    got = {r.k: r.auroc for r in statistics.auroc(d, "k").collect()}
    assert got == {"a": 0.75, "b": None}


def test_random_effects_single_study(spark):
    d = spark.createDataFrame([("a", 1.0, 0.25), ("b", 1.0, 0.5), ("b", 3.0, 0.5), ("b", None, 0.5)], "k string, g double, var_g double")
    got = [r.mu for r in statistics.random_effects(d.withColumnRenamed("k", "unit"), "unit").collect()]
    assert sorted(got) == [1.0, 2.0]


def test_bh_matches_definition(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.9]
    d = spark.createDataFrame([(x,) for x in p], "p double")
    got = sorted(r.q for r in statistics.bh(d.withColumn("g", F.lit(1)), "p", "g").collect())
    n = len(p)
    want = sorted(min(min(1.0, p[j] * n / (j + 1)) for j in range(i, n)) for i in range(n))
    assert got == pytest.approx(want)


def test_components_long_chain(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(d).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert connected_components(d.filter("a < 0")).count() == 0


def test_global_rank(spark):
    d = spark.range(0, 1000, 7).withColumnRenamed("id", "x")
    assert sorted((r.x, r.k) for r in global_rank(d, "x", "k").collect()) == [(x, i) for i, x in enumerate(range(0, 1000, 7))]


def test_tails(spark):
    d = spark.createDataFrame([(1.959964, 10.0, 2, 3, 4, 10)], "z double, df double, x long, m long, k long, n long")
    r = d.select(tails.normal_p("z").alias("a"), tails.student_p("z", "df").alias("b"), tails.hypergeometric_p("x", "m", "k", "n").alias("c")).first()
    assert r.a == pytest.approx(0.05, abs=1e-6) and r.b == pytest.approx(0.0784, abs=1e-3)
    assert r.c == pytest.approx((3 * math.comb(7, 2) + math.comb(7, 1)) / math.comb(10, 4))


def test_nnls_and_polish():
    rng = np.random.default_rng(0)
    a, x = rng.random((30, 4)), np.array([0.5, 0.0, 1.5, 0.0])
    assert np.allclose(linalg.nnls(a, a @ x), x, atol=1e-6)
    overall, rows, cols = linalg.median_polish(np.add.outer([0, 1, 2], [10.0, 20, 30]))
    assert np.allclose(np.add.outer(rows, cols) + overall, np.add.outer([0, 1, 2], [10.0, 20, 30]))
    w, v = linalg.symmetric_eigen(np.diag([1.0, 3.0]))
    assert w.tolist() == [3.0, 1.0] and abs(v[1, 0]) == 1


def test_strata_and_mode(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(8)], "k string, v double")
    assert sorted(r.stratum for r in ranks.quantile_strata(d, "v", 4, "k").collect()) == [0, 0, 1, 1, 2, 2, 3, 3]
    m = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("a", 2)], "k string, v int")
    assert ranks.mode_smallest(m, "k", "v").first()["mode"] == 1


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    """Every file that an executor writes starts processes: a round writes one a core and one for each 500,000 links, whatever the number of shuffle partitions."""
    from pathlib import Path

    from rankloom.operators import components

    files, kept = [], components.materialize

    def counted(df, name):
        out = kept(df, name)
        files.append(len(list(Path(out._written_at.removeprefix("file://")).glob("part-*"))))
        return out

    monkeypatch.setattr(components, "materialize", counted)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "16")
    spark.conf.set(keys[1], "false")
    try:
        found = components.connected_components(spark.range(300).selectExpr("id + 3 AS a", "id AS b")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found)) == [(k, k % 3) for k in range(3, 303)]
    assert len(files) > 1 and max(files[1:]) <= spark.sparkContext.defaultParallelism
