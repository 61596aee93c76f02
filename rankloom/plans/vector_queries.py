"""Grouped linear algebra and distribution tails; rows-only where SQL has no equal, the helpers held to plain versions in the tests."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import linalg, tails
from rankloom.operators import matrix as M
from rankloom.operators import statistics as T
from rankloom.operators.nearest import nearest
from rankloom.operators.polish import polished_levels
from rankloom.plans.base import query
from rankloom.plans.inference_queries import _TAIL
from rankloom.sources.shared import materialize


@query()
def pca_residual_correlation(t, components: int = 2):
    """Leading components of each cohort removed, then the best residual partner of every sample with an id divisible by 50 among all of its cohort.

    Means, spreads and components come from one blocked product per cohort; partners are searched by blocks of residuals.
    """
    rows = t.embeddings.select(F.col("vec_id").alias("sample"), (F.col("vec_id") % 4).alias("cohort"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    wide = M.width_of(rows)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        s = M.assemble(g, wide)
        mean = s[0, 1:] / s[0, 0]
        cov = s[1:, 1:] / s[0, 0] - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
        lead = linalg.symmetric_eigen(cov / np.outer(scale, scale))[1][:, :components]
        return pd.DataFrame({"cohort": g["cohort"].iloc[:1], "mean": [mean], "scale": [scale], "lead": [lead.ravel()]})

    fitted = M.products(rows, ["cohort"], wide).groupBy("cohort").applyInPandas(solve, "cohort long, mean array<double>, scale array<double>, lead array<double>").collect()  # one a cohort
    models = {m["cohort"]: (np.array(m["mean"]), np.array(m["scale"]), np.array(m["lead"]).reshape(wide, -1)) for m in fitted}

    def residual(batches):
        for b in batches:
            out = []
            for c, v in zip(b["cohort"], M.stacked(b["x"])):
                mean, scale, lead = models[c]
                z = (v - mean) / scale
                r = z - lead @ (lead.T @ z)
                out.append(r - r.mean())
            yield b.assign(x=out)

    r = materialize(rows.mapInPandas(residual, "sample long, cohort long, x array<double>"), "residuals")
    found = [nearest(own, own.filter("sample % 50 = 0"), 1) for own in (r.filter(F.col("cohort") == c) for c in sorted(models))]
    return reduce(DataFrame.union, found).select(F.col("i").alias("sample"), F.col("j").alias("partner"), F.col("w").alias("r"))


@query()
def median_polish(t):
    """Probe-set summary: sample effects of each set of eight features, over all samples of a cohort."""
    e = t.embeddings.select(F.col("vec_id").alias("sample"), (F.col("vec_id") % 4).alias("cohort"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    sets = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("e") - 1) / 8).cast("int")), lambda k: F.slice("e", k * 8 + 1, 8)))
    each = e.select("sample", "cohort", sets.alias("probe_set", "x")).select((F.col("probe_set") * 10 + F.col("cohort")).cast("long").alias("key"), "sample", "x")
    levels = polished_levels(each, "key", "sample")
    return levels.select(F.floor(F.col("key") / 10).cast("long").alias("probe_set"), "sample", F.round("level", 6).alias("level"))


@query()
def nnls_proportions(t):
    """Shares of the class profiles in each sample, by non-negative least squares on a bounded profile table."""
    m = t.assay.groupBy("label", "feature").agg(F.avg("value").alias("v")).toPandas()  # labels x features: fixed size
    a = linalg.wide(m, "feature", "label", "v").to_numpy()

    def solve(batches):
        for b in batches:
            x = np.stack(b["embedding"].to_numpy()).astype(float)
            s = np.stack([linalg.nnls(a, v) for v in x])
            s = s / np.maximum(s.sum(axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"sample": b["vec_id"], "top": s.argmax(axis=1), "share": s.max(axis=1).round(6)})

    return t.embeddings.select("vec_id", "embedding").mapInPandas(solve, "sample long, top long, share double")


@query()
def logistic_cv(t, most_rows: int = 4000):
    """Leave-one-cohort-out ridge logistic, trained on about most_rows hashed rows at most; every row of the left-out cohort is scored."""
    e = t.embeddings.select("vec_id", F.when(F.col("label") <= 4, 1).otherwise(0).alias("y"), (F.col("vec_id") % 4).alias("cohort"), "embedding")
    share = min(1.0, most_rows / max(1, e.count()))
    sample = e.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * share)))
    each = sample.withColumn("fold", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)]))).filter("fold <> cohort")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        w = linalg.logistic(np.stack(g["embedding"].to_numpy()).astype(float), g["y"].to_numpy(float))
        return pd.DataFrame({"fold": [int(g["fold"].iloc[0])], "w": [w.tolist()]})

    fitted = each.groupBy("fold").applyInPandas(solve, "fold long, w array<double>")  # one row of weights a fold
    dot = F.aggregate(F.zip_with(F.slice("w", 2, 1 << 20), "embedding", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = e.withColumnRenamed("cohort", "fold").join(F.broadcast(fitted), "fold").select("fold", "y", F.round(F.get("w", F.lit(0)) + dot, 6).alias("logit"))
    return T.auroc(scored, "fold", score="logit")


_CV = "d AS (SELECT p_brand, p_retailprice AS y, p_size::DOUBLE AS x, ('0x' || substr(md5('cv|' || p_partkey), 1, 8))::BIGINT % 5 AS k FROM part), s AS (SELECT p_brand, k, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d GROUP BY 1, 2), r AS (SELECT p_brand, k, sum(n) OVER w - n AS n, sum(sx) OVER w - sx AS sx, sum(sy) OVER w - sy AS sy, sum(sxx) OVER w - sxx AS sxx, sum(sxy) OVER w - sxy AS sxy FROM s WINDOW w AS (PARTITION BY p_brand)), f AS (SELECT p_brand, k, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS b, sy / n AS m, sx / n AS mx FROM r)"


@query(f"WITH {_CV} SELECT d.p_brand, round(1 - sum((y - (m - b * mx) - b * x) * (y - (m - b * mx) - b * x)) / sum((y - m) * (y - m)), 5) AS cv_r2 FROM d JOIN f ON d.p_brand = f.p_brand AND d.k = f.k GROUP BY 1")
def cv_r2(t):
    """Five-fold cross-validated R squared of one predictor per brand, folds by hash."""
    from pyspark.sql import Window as W

    d = t.part.select("p_brand", F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x"), (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("cv"), F.col("p_partkey").cast("string"))), 1, 8), 16, 10).cast("long") % 5).alias("k"))
    s = d.groupBy("p_brand", "k").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    rest = s.select("p_brand", "k", *((F.sum(c).over(W.partitionBy("p_brand")) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    fit = rest.select("p_brand", "k", slope.alias("b"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("a"), (F.col("sy") / F.col("n")).alias("m"))
    e = d.join(fit, ["p_brand", "k"])
    err, tot = F.col("y") - F.col("a") - F.col("b") * F.col("x"), F.col("y") - F.col("m")
    return e.groupBy("p_brand").agg(F.round(1 - F.sum(err * err) / F.sum(tot * tot), 5).alias("cv_r2"))


@query()
def welch_t_p(t):
    """Welch test with Student tails and q values."""
    from rankloom.plans.stat_queries import _arms

    w = T.welch_t(_arms(t).filter("n1 > 2 AND n0 > 2")).select("cohort", "feature", "t", tails.student_p("t", "df").alias("p"))
    w = materialize(w, "welch")  # q values are joined back by p
    return T.bh(w, "p", "cohort").select("cohort", "feature", "t", "p", "q")


_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"
_ORA = (
    "u AS (SELECT p_brand AS lib, p_type AS set_id, (p_size <= 10)::INT AS hit FROM part), a AS (SELECT lib, count(*) AS n, sum(hit) AS k FROM u GROUP BY 1), s AS (SELECT lib, set_id, count(*) AS m, sum(hit) AS x FROM u GROUP BY 1, 2), "
    "j AS (SELECT s.lib, set_id, m, x, n, k, x * n / (m * k) AS fold, unnest(range(greatest(x, k - n + m)::BIGINT, least(m, k)::BIGINT + 1)) AS i FROM s JOIN a ON s.lib = a.lib WHERE m >= 2 AND k > 0), "
    f"p AS (SELECT lib, set_id, any_value(fold) AS fold, least(1, sum(exp({_CHOOSE.format('m', 'i')} + {_CHOOSE.format('(n - m)', '(k - i)')} - ({_CHOOSE.format('n', 'k')})))) AS p FROM j GROUP BY 1, 2), "
    "r AS (SELECT *, p * count(*) OVER (PARTITION BY lib) / row_number() OVER (PARTITION BY lib ORDER BY p) AS x FROM p)"
)


@query(f"WITH {_ORA} SELECT lib, set_id, round(fold, 6) AS fold, round(p, 7) AS p, round(least(1, min(x) OVER (PARTITION BY lib ORDER BY round(p, 10) DESC)), 6) AS q FROM r")
def ora_hypergeometric(t):
    """Over-representation with the hypergeometric tail and q values within a library."""
    from rankloom.plans.stat_queries import ora_counts_fold as counts

    c = counts(t)
    u = t.part.groupBy(F.col("p_brand").alias("lib")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("p_size") <= 10).cast("long")).alias("k"))
    p = c.join(u, "lib").withColumn("p", tails.hypergeometric_p("x", "m", "k", "n"))
    return T.bh(p, "p", "lib").select("lib", "set_id", "fold", F.round("p", 7).alias("p"), F.round("q", 6).alias("q"))


_SIDES = "d AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') - avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS d FROM lineitem GROUP BY 1)"


@query(f"WITH {_SIDES}, s AS (SELECT count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d <> 0) AS n FROM d), e AS (SELECT up, n, unnest(range(0, least(up, n - up) + 1)) AS i FROM s) SELECT up, n, round(least(1, 2 * sum(exp({_CHOOSE.format('n', 'i')} - n * ln(2.0::DOUBLE)))), 8) AS p FROM e GROUP BY 1, 2")
def sign_test(t):
    """Two-sided sign test of agreement between paired return flags."""
    side = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    p = t.lineitem.groupBy("l_suppkey").agg((side("A") - side("R")).alias("d"))
    s = p.agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") != 0).alias("n"))
    return s.select("up", "n", F.round(tails.binomial_p("up", "n"), 8).alias("p"))


@query(f"WITH {_SIDES}, k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0), s AS (SELECT sum(CASE WHEN d > 0 THEN rk ELSE 0 END)::DOUBLE AS w, count(*) AS n FROM k), z AS (SELECT w, n, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM s) SELECT w, n, round(z, 6) AS z, round({_TAIL.format('(abs(z) / sqrt(2.0::DOUBLE))')}, 5) AS p FROM z")
def wilcoxon_signed_rank(t):
    """Signed-rank statistic and its normal p value over suppliers, ranks by prefix sums over bins."""
    side = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    p = t.lineitem.groupBy("l_suppkey").agg((side("A") - side("R")).alias("d")).filter("d <> 0").select(F.lit(1).alias("all"), "d", F.abs("d").alias("m"))
    p = materialize(p, "differences")  # ranks are joined back by value, and a mean made twice may differ in its last digit
    s = T.spread_rank(p, "all", "m", "rk").agg(F.sum(F.when(F.col("d") > 0, F.col("rk")).otherwise(0.0)).alias("w"), F.count(F.lit(1)).alias("n"))
    z = (F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24)
    return s.select("w", "n", z.alias("z")).select("w", "n", F.round(tails.normal_p("z"), 5).alias("p"), F.round("z", 6).alias("z"))
