"""Effect sizes, ROC, correlation, regression, meta-analysis, multiple testing, enrichment."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import matrix as M
from rankloom.operators import ranks as R
from rankloom.operators import statistics as T
from rankloom.operators.ordering import binned_prefix
from rankloom.plans.base import query, r6
from rankloom.sources.relations import ASSAY, CASES

_ARMS = f"{ASSAY}, x AS (SELECT cohort, feature, label, value FROM assay WHERE label IN (0, 1)), arms AS (SELECT cohort, feature, count(*) FILTER (WHERE label = 1) AS n1, avg(value) FILTER (WHERE label = 1) AS m1, var_samp(value) FILTER (WHERE label = 1) AS v1, count(*) FILTER (WHERE label = 0) AS n0, avg(value) FILTER (WHERE label = 0) AS m0, var_samp(value) FILTER (WHERE label = 0) AS v0 FROM x GROUP BY 1, 2)"
_G = f"{_ARMS}, g0 AS (SELECT *, CASE WHEN n1 >= 3 AND n0 >= 3 THEN (1 - 3.0::DOUBLE / (4 * (n1 + n0) - 9)) * (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) END AS g FROM arms), g AS (SELECT *, (n1 + n0) / (n1 * n0) + g * g / (2 * (n1 + n0)) AS var_g FROM g0)"
_WELCH = f"{_ARMS}, w AS (SELECT cohort, feature, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, (v1 / n1 + v0 / n0) * (v1 / n1 + v0 / n0) / (v1 / n1 * v1 / n1 / (n1 - 1) + v0 / n0 * v0 / n0 / (n0 - 1)) AS df FROM arms WHERE n1 > 2 AND n0 > 2)"
_DL = f"{_G}, u AS (SELECT feature, g, var_g AS v, 1 / var_g AS w FROM g WHERE g IS NOT NULL AND var_g > 0), s AS (SELECT feature, count(*) AS k, avg((g > 0)::INT) AS share_up, sum(w) AS sw, sum(w * w) AS sww, sum(w * g) AS swx, sum(w * g * g) AS swxx FROM u GROUP BY 1), q AS (SELECT *, swxx - swx * swx / sw AS q FROM s), tau AS (SELECT feature, k, share_up, CASE WHEN k > 1 THEN greatest(0, (q - (k - 1)) / (sw - sww / sw)) ELSE 0 END AS tau2, CASE WHEN k > 1 AND q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END AS i2 FROM q), dl AS (SELECT u.feature, any_value(k) AS k, any_value(share_up) AS share_up, any_value(tau2) AS tau2, any_value(i2) AS i2, sum(g / (v + tau2)) / sum(1 / (v + tau2)) AS mu, sqrt(1 / sum(1 / (v + tau2))) AS se FROM u JOIN tau ON u.feature = tau.feature GROUP BY 1)"
_AUC = "{0}, rk AS (SELECT {1}, y, rank() OVER (PARTITION BY {1} ORDER BY {2}) + (count(*) OVER (PARTITION BY {1}, {2}) - 1) / 2 AS rk FROM {3}), auc AS (SELECT {1}, sum(y) AS p, count(*) - sum(y) AS q, CASE WHEN sum(y) > 0 AND count(*) > sum(y) THEN (sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END AS auroc FROM rk GROUP BY {1})"


def _arms(t):
    return T.arms(t.assay.filter("label IN (0, 1)"), ["cohort", "feature"], F.col("label"))


def _g(t):
    return T.hedges_g(_arms(t))


@query(f"WITH {_G} SELECT cohort, feature, round(g, 6) AS g, round(var_g, 6) AS var_g FROM g")
def hedges_g_var(t):
    return _g(t).select("cohort", "feature", r6("g"), r6("var_g"))


@query(f"WITH {ASSAY}, s AS (SELECT feature, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, sum(value) FILTER (WHERE label = 1) AS s1, sum(value) FILTER (WHERE label = 0) AS s0, sum(value * value) FILTER (WHERE label = 1) AS q1, sum(value * value) FILTER (WHERE label = 0) AS q0 FROM assay GROUP BY 1) SELECT feature, round((s1 / n1 - s0 / n0) / (sqrt((q1 - s1 * s1 / n1 + q0 - s0 * s0 / n0) / (n1 + n0 - 2)) + 1e-9), 6) AS d FROM s")
def cohen_d_sufficient(t):
    """From sums and sums of squares alone."""
    agg = lambda k, e: F.sum(F.when(F.col("label") == k, e))
    v = F.col("value")
    s = t.assay.groupBy("feature").agg(*(agg(k, e).alias(f"{n}{k}") for k in (1, 0) for n, e in (("n", F.lit(1)), ("s", v), ("q", v * v))))
    ss = lambda k: F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col(f"n{k}")
    sd = F.sqrt((ss(1) + ss(0)) / (F.col("n1") + F.col("n0") - 2)) + 1e-9
    return s.select("feature", r6((F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")) / sd, "d"))


@query(f"WITH {_WELCH} SELECT cohort, feature, round(t, 6) AS t, round(df, 6) AS df FROM w")
def welch_t(t):
    return T.welch_t(_arms(t).filter("n1 > 2 AND n0 > 2")).select("cohort", "feature", r6("t"), r6("df"))


@query("WITH p AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') - avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS d, l_linestatus FROM lineitem GROUP BY l_suppkey, l_linestatus) SELECT l_linestatus, count(d) AS n, round(avg(d) / stddev_samp(d), 6) AS dz, round(avg(d) / stddev_samp(d) * sqrt(count(d)), 6) AS t FROM p GROUP BY 1")
def paired_dz(t):
    side = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    p = t.lineitem.groupBy("l_suppkey", "l_linestatus").agg((side("A") - side("R")).alias("d"))
    dz = F.avg("d") / F.stddev_samp("d")
    return p.groupBy("l_linestatus").agg(F.count("d").alias("n"), r6(dz, "dz"), r6(dz * F.sqrt(F.count("d")), "t"))


@query("WITH " + _AUC.format(CASES, "cohort", "score", "cases") + " SELECT cohort, p::BIGINT AS n_pos, q::BIGINT AS n_neg, round(auroc, 6) AS auroc FROM auc")
def auroc(t):
    return T.auroc(t.cases, "cohort").select("cohort", "n_pos", "n_neg", r6("auroc"))


@query("WITH " + _AUC.format(CASES + ", f AS (SELECT cohort, regr_slope(score, covariate) AS b, regr_intercept(score, covariate) AS a FROM cases WHERE y = 0 GROUP BY 1), res AS (SELECT cases.cohort, y, round(score - a - b * covariate, 6) AS resid FROM cases JOIN f ON cases.cohort = f.cohort)", "cohort", "resid", "res") + " SELECT cohort, round(auroc, 5) AS auroc FROM auc")
def auroc_adjusted(t):
    res = T.residual_on_negatives(t.cases, "cohort").withColumn("resid", F.round("resid", 6))
    return T.auroc(res, "cohort", score="resid").select("cohort", F.round("auroc", 5).alias("auroc"))


@query("WITH " + _AUC.format(CASES + ", st AS (SELECT cohort, floor(covariate / 60)::BIGINT AS stratum, y, score FROM cases)", "cohort, stratum", "score", "st") + " SELECT cohort, round(sum(auroc * p * q) / sum(p * q), 6) AS auroc FROM auc WHERE auroc IS NOT NULL GROUP BY cohort")
def auroc_stratified(t):
    st = t.cases.withColumn("stratum", F.floor(F.col("covariate") / 60))
    a = T.auroc(st, ["cohort", "stratum"]).filter("auroc IS NOT NULL")
    w = F.col("n_pos") * F.col("n_neg")
    return a.groupBy("cohort").agg(r6(F.sum(F.col("auroc") * w) / F.sum(w), "auroc"))


@query("WITH " + _AUC.format(CASES + ", st AS (SELECT cohort, floor(covariate / 60)::BIGINT AS stratum, y, score FROM cases)", "cohort, stratum", "score", "st") + " SELECT cohort, stratum, round(auroc, 6) AS auroc FROM auc")
def auroc_within_strata(t):
    st = t.cases.withColumn("stratum", F.floor(F.col("covariate") / 60))
    return T.auroc(st, ["cohort", "stratum"]).select("cohort", "stratum", r6("auroc"))


@query("WITH " + _AUC.format(CASES, "cohort", "score", "cases") + " SELECT cohort, round(2 * auroc - 1, 6) AS delta FROM auc")
def cliffs_delta(t):
    return T.auroc(t.cases, "cohort").select("cohort", r6(2 * F.col("auroc") - 1, "delta"))


@query("WITH " + _AUC.format(CASES, "cohort", "score", "cases") + ", h AS (SELECT *, auroc / (2 - auroc) AS q1, 2 * auroc * auroc / (1 + auroc) AS q2 FROM auc WHERE auroc > 0 AND auroc < 1), v AS (SELECT cohort, auroc, (auroc * (1 - auroc) + (p - 1) * (q1 - auroc * auroc) + (q - 1) * (q2 - auroc * auroc)) / (p * q) AS v FROM h) SELECT cohort, round(ln(auroc / (1 - auroc)), 6) AS logit, round(v / (auroc * (1 - auroc) * auroc * (1 - auroc)), 6) AS v_logit FROM v")
def logit_auc_variance(t):
    """Hanley-McNeil variance carried to the logit scale by the delta rule."""
    a, p, q = F.col("auroc"), F.col("n_pos"), F.col("n_neg")
    v = (a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (q - 1) * (2 * a * a / (1 + a) - a * a)) / (p * q)
    return T.auroc(t.cases, "cohort").filter("auroc > 0 AND auroc < 1").select("cohort", r6(F.ln(a / (1 - a)), "logit"), r6(v / (a * (1 - a) * a * (1 - a)), "v_logit"))


def _from_top(t):
    """Positives and negatives at or over each distinct score, and in all; prefix sums run over bins, so no task holds a cohort."""
    v = t.cases.groupBy("cohort", "score").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("q"))
    tot = v.groupBy("cohort").agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    c = binned_prefix(v, ["cohort"], "score", ["p", "q"]).join(tot, "cohort")
    return c.withColumn("tp", F.col("all_p") - F.col("before_p")).withColumn("fp", F.col("all_q") - F.col("before_q"))


@query(f"WITH {CASES}, v AS (SELECT cohort, score, sum(y) AS p, count(*) AS n FROM cases GROUP BY 1, 2), c AS (SELECT cohort, p, sum(p) OVER w AS tp, sum(n) OVER w AS np, sum(p) OVER (PARTITION BY cohort) AS tot FROM v WINDOW w AS (PARTITION BY cohort ORDER BY score DESC)) SELECT cohort, round(sum(p * tp / np) / max(tot), 6) AS ap FROM c GROUP BY 1")
def avg_precision(t):
    c = _from_top(t)
    return c.groupBy("cohort").agg(r6(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p"), "ap"))


@query(f"WITH {CASES}, p AS (SELECT cohort, y, 1 / (1 + exp(-(score - 150000) / 100000)) AS p FROM cases) SELECT cohort, round(avg((p - y) * (p - y)), 6) AS brier FROM p GROUP BY 1")
def brier(t):
    p = 1 / (1 + F.exp(-(F.col("score") - 150000) / 100000))
    return t.cases.withColumn("e", p - F.col("y")).groupBy("cohort").agg(r6(F.avg(F.col("e") * F.col("e")), "brier"))


@query(f"WITH {CASES}, v AS (SELECT cohort, score, sum(y) AS p, count(*) - sum(y) AS q FROM cases GROUP BY 1, 2), c AS (SELECT cohort, score, sum(p) OVER w / sum(p) OVER (PARTITION BY cohort) - sum(q) OVER w / sum(q) OVER (PARTITION BY cohort) AS j FROM v WINDOW w AS (PARTITION BY cohort ORDER BY score DESC)) SELECT cohort, score AS threshold, round(j, 6) AS j FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY round(j, 12) DESC, score DESC) AS k FROM c) WHERE k = 1")
def youden(t):
    j = F.col("tp") / F.col("all_p") - F.col("fp") / F.col("all_q")
    best = _from_top(t).select("cohort", "score", j.alias("j")).groupBy("cohort").agg(F.max(F.struct(F.round("j", 12).alias("r"), "score", "j")).alias("b"))
    return best.select("cohort", F.col("b.score").alias("threshold"), r6("b.j", "j"))


_SP = f"{CASES}, k AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY score) + (count(*) OVER (PARTITION BY cohort, score) - 1) / 2 AS ra, rank() OVER (PARTITION BY cohort ORDER BY covariate) + (count(*) OVER (PARTITION BY cohort, covariate) - 1) / 2 AS rb FROM cases)"


@query(f"WITH {_SP} SELECT cohort, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM k GROUP BY 1")
def spearman_grouped(t):
    return T.spearman(t.cases, "cohort", "score", "covariate").select("cohort", "n", r6("rho"))


@query("WITH c AS (SELECT l_returnflag AS g, l_extendedprice AS a, l_discount AS b, l_quantity AS c FROM lineitem), k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2 AS rb, rank() OVER (PARTITION BY g ORDER BY c) + (count(*) OVER (PARTITION BY g, c) - 1) / 2 AS rc FROM c), r AS (SELECT g, corr(ra, rb) AS ab, corr(ra, rc) AS ac, corr(rb, rc) AS bc FROM k GROUP BY 1) SELECT g, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS rho FROM r")
def spearman_partial(t):
    """Rank correlation with the third variable's ranks held constant."""
    d = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("a"), F.col("l_discount").alias("b"), F.col("l_quantity").alias("c"))
    base = d
    for c in "abc":
        d = T.spread_rank(d, "g", c, f"r{c}", base)
    r = d.groupBy("g").agg(F.corr("ra", "rb").alias("ab"), F.corr("ra", "rc").alias("ac"), F.corr("rb", "rc").alias("bc"))
    ab, ac, bc = F.col("ab"), F.col("ac"), F.col("bc")
    return r.select("g", r6((ab - ac * bc) / F.sqrt((1 - ac * ac) * (1 - bc * bc)), "rho"))


@query(f"WITH {ASSAY} SELECT a.feature AS f, b.feature AS g, round(corr(a.value, b.value), 6) AS r FROM assay a JOIN assay b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2")
def pearson_matrix(t):
    """Feature by feature, from the blocks of one product of the whole matrix with itself; 0 stands for the column of ones."""
    rows = t.embeddings.select(F.lit(0).alias("all"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    wide = M.width_of(rows)
    e = M.entries(M.products(rows, ["all"], wide), ["all"], wide)
    n = e.filter("i = 0 AND j = 0").select("all", F.col("v").alias("n"))
    sums = e.filter("i = 0 AND j > 0").select(F.col("j").alias("k"), F.col("v").alias("s"))
    one = e.filter("i = j AND i > 0").select(F.col("i").alias("k"), F.col("v").alias("ss")).join(sums, "k")
    f, g = (one.toDF(c, f"ss_{c}", f"s_{c}") for c in "fg")
    each = e.filter("0 < i AND i < j").select("all", F.col("i").alias("f"), F.col("j").alias("g"), "v").join(f, "f").join(g, "g").join(n, "all")
    spread = lambda c: F.sqrt(F.col("n") * F.col(f"ss_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}"))
    return each.select("f", "g", r6((F.col("n") * F.col("v") - F.col("s_f") * F.col("s_g")) / (spread("f") * spread("g")), "r"))


@query("WITH f AS (SELECT p_brand, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, regr_r2(p_retailprice, p_size) AS r2 FROM part GROUP BY 1) SELECT p_partkey, round(p_retailprice - a - b * p_size, 4) AS resid, round(r2, 6) AS r2 FROM part JOIN f ON part.p_brand = f.p_brand")
def ols_residualise(t):
    f = t.part.groupBy("p_brand").agg(F.regr_slope("p_retailprice", "p_size").alias("b"), F.regr_intercept("p_retailprice", "p_size").alias("a"), F.regr_r2("p_retailprice", "p_size").alias("r2"))
    return t.part.join(f, "p_brand").select("p_partkey", F.round(F.col("p_retailprice") - F.col("a") - F.col("b") * F.col("p_size"), 4).alias("resid"), r6("r2"))


_OLS2 = "count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, covar_pop(l_extendedprice, l_quantity) AS c1, covar_pop(l_extendedprice, l_discount) AS c2, covar_pop(l_quantity, l_discount) AS c12, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2"


@query(f"WITH s AS (SELECT l_returnflag, {_OLS2} FROM lineitem GROUP BY 1) SELECT l_returnflag, n, round((c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12), 3) AS b1, round((c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12), 3) AS b2 FROM s")
def ols_two_predictor(t):
    """Closed-form normal equations from moments: one pass, map-side combined."""
    s = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("l_extendedprice", "l_quantity").alias("c1"), F.covar_pop("l_extendedprice", "l_discount").alias("c2"), F.covar_pop("l_quantity", "l_discount").alias("c12"), F.var_pop("l_quantity").alias("v1"), F.var_pop("l_discount").alias("v2"))
    det = F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12")
    return s.select("l_returnflag", "n", F.round((F.col("c1") * F.col("v2") - F.col("c2") * F.col("c12")) / det, 3).alias("b1"), F.round((F.col("c2") * F.col("v1") - F.col("c1") * F.col("c12")) / det, 3).alias("b2"))


@query(f"WITH {_DL} SELECT feature, k, round(share_up, 6) AS share_up, round(tau2, 6) AS tau2, round(i2, 6) AS i2, round(mu, 6) AS mu, round(se, 6) AS se FROM dl")
def dl_meta_per_feature(t):
    return T.random_effects(_g(t), "feature").select("feature", "k", *(r6(c) for c in ("share_up", "tau2", "i2", "mu", "se")))


@query(f"WITH {_DL}, z AS (SELECT feature, mu / se AS z FROM dl), b AS (SELECT feature % 8 AS block, z FROM z) SELECT block, count(*) AS n, round(sum(z) / sqrt(count(*)), 5) AS stouffer FROM b GROUP BY 1")
def stouffer(t):
    z = T.random_effects(_g(t), "feature").select((F.col("feature") % 8).alias("block"), (F.col("mu") / F.col("se")).alias("z"))
    return z.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z") / F.sqrt(F.count(F.lit(1))), 5).alias("stouffer"))


_P = "p AS (SELECT p_partkey AS id, p_brand AS grp, (('0x' || substr(md5('p|' || p_partkey), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE AS p FROM part)"


def _p(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), ((F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("p"), F.col("p_partkey").cast("string"))), 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967297.0)).alias("p"))


@query(f"WITH {_P}, i AS (SELECT *, p * count(*) OVER (PARTITION BY grp) / row_number() OVER (PARTITION BY grp ORDER BY p) AS x FROM p) SELECT id, round(least(1, min(x) OVER (PARTITION BY grp ORDER BY p DESC)), 6) AS q FROM i")
def bh_fdr(t):
    return T.bh(_p(t), "p", "grp").select("id", r6("q"))


@query(f"WITH {_P} SELECT id, round(least(1, p * count(*) OVER (PARTITION BY grp)), 6) AS q FROM p")
def bonferroni(t):
    return _p(t).select("id", r6(F.least(F.lit(1.0), F.col("p") * F.count(F.lit(1)).over(W.partitionBy("grp"))), "q"))


@query("WITH d AS (SELECT l_returnflag AS g, l_extendedprice AS a, l_quantity * 1500 AS b FROM lineitem) SELECT g, round(2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) * (avg(a) - avg(b))), 6) AS ccc, round(sqrt(avg((a - b) * (a - b))), 4) AS rmse, round(avg(abs(a - b)), 4) AS mae FROM d GROUP BY 1")
def ccc_rmse_mae(t):
    a, b = F.col("l_extendedprice"), F.col("l_quantity") * 1500
    gap = F.avg(a) - F.avg(b)
    return t.lineitem.groupBy(F.col("l_returnflag").alias("g")).agg(r6(2 * F.covar_pop(a, b) / (F.var_pop(a) + F.var_pop(b) + gap * gap), "ccc"), F.round(F.sqrt(F.avg((a - b) * (a - b))), 4).alias("rmse"), F.round(F.avg(F.abs(a - b)), 4).alias("mae"))


@query(f"WITH {ASSAY}, m AS (SELECT feature, avg(value) FILTER (WHERE label = 1) - avg(value) FILTER (WHERE label = 0) AS a, avg(value) FILTER (WHERE label = 2) - avg(value) FILTER (WHERE label = 0) AS b, avg(value) FILTER (WHERE label = 3) - avg(value) FILTER (WHERE label = 0) AS c FROM assay GROUP BY 1) SELECT round(corr(a, b), 6) AS r_ab, round(corr(a, c), 6) AS r_ac, round(corr(a, b) / corr(a, c), 5) AS ratio FROM m")
def specificity_ratio(t):
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("value")))
    m = t.assay.groupBy("feature").agg(*((side(k) - side(0)).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))))
    return m.agg(r6(F.corr("a", "b"), "r_ab"), r6(F.corr("a", "c"), "r_ac"), F.round(F.corr("a", "b") / F.corr("a", "c"), 5).alias("ratio"))


@query("WITH m AS (SELECT l_returnflag AS method, l_suppkey AS cell, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT cell, v FROM m WHERE method = 'N'), d AS (SELECT method, m.v - b.v AS d FROM m JOIN b ON m.cell = b.cell) SELECT method, round(avg(d), 4) AS mean, avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)) > -5000 AS noninferior FROM d GROUP BY 1")
def noninferiority(t):
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("cell")).agg(F.avg("l_extendedprice").alias("v"))
    d = m.join(m.filter("method = 'N'").select("cell", F.col("v").alias("b")), "cell").withColumn("d", F.col("v") - F.col("b"))
    return d.groupBy("method").agg(F.round(F.avg("d"), 4).alias("mean"), (F.avg("d") - 1.96 * F.stddev_samp("d") / F.sqrt(F.count(F.lit(1))) > -5000).alias("noninferior"))


@query(f"WITH {ASSAY}, s AS (SELECT feature, avg(value) AS x FROM assay GROUP BY 1), k AS (SELECT feature % 6 AS set_id, x FROM s), a AS (SELECT avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM s) SELECT set_id, count(*) AS size, round((avg(x) - any_value(m)) / sqrt(any_value(v) / count(*) * (any_value(n) - count(*)) / (any_value(n) - 1)), 6) AS z FROM k, a GROUP BY 1")
def mean_in_set_z_analytic(t):
    """Mean of a set against drawing it without replacement: the finite-population z."""
    s = t.assay.groupBy("feature").agg(F.avg("value").alias("x"))
    a = s.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))
    g = s.groupBy((F.col("feature") % 6).alias("set_id")).agg(F.count(F.lit(1)).alias("size"), F.avg("x").alias("x")).join(F.broadcast(a))
    return g.select("set_id", "size", r6((F.col("x") - F.col("m")) / F.sqrt(F.col("v") / F.col("size") * (F.col("n") - F.col("size")) / (F.col("n") - 1)), "z"))


@query("WITH u AS (SELECT p_partkey, p_brand AS lib, p_type AS set_id, (p_size <= 10)::INT AS hit FROM part), t AS (SELECT lib, count(*) AS n, sum(hit) AS k FROM u GROUP BY 1), s AS (SELECT lib, set_id, count(*) AS m, sum(hit) AS x FROM u GROUP BY 1, 2) SELECT s.lib, set_id, m, x::BIGINT AS x, round(x * n / (m * k), 6) AS fold FROM s JOIN t ON s.lib = t.lib WHERE m >= 2 AND k > 0")
def ora_counts_fold(t):
    u = t.part.select(F.col("p_brand").alias("lib"), F.col("p_type").alias("set_id"), (F.col("p_size") <= 10).cast("long").alias("hit"))
    s = u.groupBy("lib", "set_id").agg(F.count(F.lit(1)).alias("m"), F.sum("hit").alias("x"))
    tot = s.groupBy("lib").agg(F.sum("m").alias("n"), F.sum("x").alias("k"))
    return s.join(tot, "lib").filter("m >= 2 AND k > 0").select("lib", "set_id", "m", "x", r6(F.col("x") * F.col("n") / (F.col("m") * F.col("k")), "fold"))


@query(f"WITH {ASSAY}, s AS (SELECT feature, avg(value) AS x FROM assay GROUP BY 1), k AS (SELECT feature % 6 AS set_id, rank() OVER (ORDER BY x) AS rk FROM s), n AS (SELECT count(*) AS n FROM s) SELECT set_id, round((sum(rk) - count(*) * (any_value(n) + 1) / 2) / sqrt(count(*) * (any_value(n) - count(*)) * (any_value(n) + 1) / 12), 6) AS z FROM k, n GROUP BY 1")
def ranked_set_u_z(t):
    """Rank-sum z of each set among all features (features number a few thousand: one ordered list)."""
    s = t.assay.groupBy("feature").agg(F.avg("value").alias("x"))
    k = R.average_rank(s.withColumn("all", F.lit(1)), "all", "x")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    g = k.groupBy((F.col("feature") % 6).alias("set_id")).agg(F.sum("rk").alias("s"), F.count(F.lit(1)).alias("m")).join(F.broadcast(n))
    m, n_ = F.col("m"), F.col("n")
    return g.select("set_id", r6((F.col("s") - m * (n_ + 1) / 2) / F.sqrt(m * (n_ - m) * (n_ + 1) / 12), "z"))


@query(f"WITH {ASSAY}, s AS (SELECT feature, avg(value) AS x FROM assay GROUP BY 1), g AS (SELECT unnest(range(0, 6)) AS set_id), e AS (SELECT set_id, x, feature % 6 = set_id AS hit FROM s, g), w AS (SELECT set_id, x, CASE WHEN hit THEN abs(x) / sum(CASE WHEN hit THEN abs(x) END) OVER (PARTITION BY set_id) ELSE -1 / sum((NOT hit)::INT) OVER (PARTITION BY set_id) END AS step FROM e), r AS (SELECT set_id, sum(step) OVER (PARTITION BY set_id ORDER BY x DESC) AS run FROM w) SELECT set_id, round(max(run), 6) AS es_up, round(min(run), 6) AS es_down FROM r GROUP BY 1")
def gsea_running_sum(t):
    """Running-sum enrichment score of each set over the ranked features."""
    s = t.assay.groupBy("feature").agg(F.avg("value").alias("x")).withColumn("set_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(6)])))
    hit = F.col("feature") % 6 == F.col("set_id")
    own = W.partitionBy("set_id")
    step = F.when(hit, F.abs("x") / F.sum(F.when(hit, F.abs("x"))).over(own)).otherwise(-1 / F.sum((~hit).cast("int")).over(own))
    r = s.withColumn("step", step).select("set_id", F.sum("step").over(own.orderBy(F.desc("x"))).alias("run"))
    return r.groupBy("set_id").agg(r6(F.max("run"), "es_up"), r6(F.min("run"), "es_down"))
