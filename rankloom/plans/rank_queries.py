"""Ranks, centring, strata and top-k."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import ranks
from rankloom.plans.base import query, r6
from rankloom.sources.relations import ASSAY, RANKED


@query(f"WITH {ASSAY}, {RANKED} SELECT sample, feature, rk::DOUBLE AS rk FROM ranked")
def rank_avg_within_sample(t):
    return ranks.average_rank(t.assay, "sample").select("sample", "feature", "rk")


@query(f"WITH {ASSAY}, {RANKED} SELECT sample, feature, round(r, 6) AS r FROM ranks")
def rank_pct_nminus1(t):
    return ranks.percentile_rank(t.assay, "sample").select("sample", "feature", r6("r"))


@query(f"WITH {ASSAY}, {RANKED} SELECT sample, feature, round(rk / nf, 6) AS r FROM ranked")
def rank_pct_n(t):
    return ranks.percentile_rank(t.assay, "sample", minus_one=False).select("sample", "feature", r6("r"))


@query(f"WITH {ASSAY} SELECT sample, feature, row_number() OVER (PARTITION BY sample ORDER BY value, feature) AS rn FROM assay")
def rank_ordinal_tiebreak(t):
    return ranks.ordinal_rank(t.assay, "sample", [F.col("value"), F.col("feature")]).select("sample", "feature", "rn")


@query(f"WITH {ASSAY}, m AS (SELECT * FROM assay WHERE (sample * 7 + feature) % 11 <> 0), k AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY sample) AS n FROM m) SELECT sample, feature, n, round((rk - 1) / (n - 1), 6) AS r FROM k")
def rank_missing_aware(t):
    seen = t.assay.filter((F.col("sample") * 7 + F.col("feature")) % 11 != 0)
    n = F.count(F.lit(1)).over(W.partitionBy("sample"))
    return ranks.percentile_rank(seen, "sample").select("sample", "feature", n.alias("n"), r6("r"))


@query(f"WITH {ASSAY} SELECT sample, feature, round((value - avg(value) OVER w) / (stddev_samp(value) OVER w), 6) AS z FROM assay WINDOW w AS (PARTITION BY cohort, feature)")
def zscore_within_cohort(t):
    return ranks.zscore(t.assay, ["cohort", "feature"]).select("sample", "feature", r6("z"))


@query(f"WITH {ASSAY} SELECT sample, feature, round(value - coalesce(avg(CASE WHEN label = 0 THEN value END) OVER w, avg(value) OVER w), 6) AS c FROM assay WINDOW w AS (PARTITION BY cohort, feature)")
def center_by_reference_arm(t):
    return ranks.center_on(t.assay, ["cohort", "feature"], "value", F.col("label") == 0).select("sample", "feature", r6("c"))


@query("WITH e AS (SELECT c_mktsegment, list_distinct(quantile_cont(c_acctbal, [0.25, 0.5, 0.75])) AS e FROM customer GROUP BY 1) SELECT c_custkey, c.c_mktsegment, len(list_filter(e, lambda x: x < c_acctbal))::BIGINT AS stratum FROM customer c JOIN e ON c.c_mktsegment = e.c_mktsegment")
def qcut_strata(t):
    return ranks.quantile_strata(t.customer, "c_acctbal", 4, "c_mktsegment").select("c_custkey", "c_mktsegment", "stratum")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def topn_per_group(t):
    return ranks.top_n(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query(f"WITH {ASSAY}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, feature) AS k FROM assay) SELECT sample, max(CASE WHEN k = 1 THEN feature END) AS best, round(max(CASE WHEN k = 1 THEN value END) - max(CASE WHEN k = 2 THEN value END), 6) AS gap FROM k WHERE k <= 2 GROUP BY sample")
def runner_up_gap(t):
    top = ranks.ordinal_rank(t.assay, "sample", [F.desc("value"), F.col("feature")], "k").filter("k <= 2")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return top.groupBy("sample").agg(at(1, "feature").alias("best"), r6(at(1, "value") - at(2, "value"), "gap"))


@query("SELECT p_brand, p_size AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)) WHERE k = 1")
def mode_smallest_tie(t):
    return ranks.mode_smallest(t.part, "p_brand", "p_size")


@query(f"WITH {ASSAY}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, feature) AS k FROM assay), m AS (SELECT k, avg(value) AS qn FROM k GROUP BY k) SELECT sample, feature, round(qn, 6) AS qn FROM k JOIN m ON k.k = m.k")
def quantile_normalise(t):
    return ranks.quantile_normalise(t.assay).select("sample", "feature", r6("qn"))


@query(f"WITH {ASSAY} SELECT feature, round(var_samp(value), 6) AS v FROM assay GROUP BY feature ORDER BY var_samp(value) DESC, feature LIMIT 20")
def top_variance_features(t):
    return t.assay.groupBy("feature").agg(F.var_samp("value").alias("v")).orderBy(F.desc("v"), "feature").limit(20).select("feature", r6("v"))


@query(f"WITH {ASSAY}, d AS (SELECT feature, avg(CASE WHEN label = 1 THEN value END) - avg(CASE WHEN label = 0 THEN value END) AS d FROM assay GROUP BY feature) SELECT feature, round(d, 6) AS d FROM d ORDER BY abs(d) DESC, feature LIMIT 15")
def topk_abs_keep_sign(t):
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("value")))
    return t.assay.groupBy("feature").agg((side(1) - side(0)).alias("d")).orderBy(F.desc(F.abs("d")), "feature").limit(15).select("feature", r6("d"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def cumcount_and_group_size(t):
    w = W.partitionBy("o_custkey")
    return t.orders.select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("seq"), F.count(F.lit(1)).over(w).alias("n"))


@query("WITH s AS (SELECT o_orderkey, o_orderdate, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT o_orderkey, round(avg(o_totalprice) OVER (ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 4) AS smooth, round(o_totalprice - 2 * lag(o_totalprice) OVER (ORDER BY k) + lag(o_totalprice, 2) OVER (ORDER BY k), 4) AS bend FROM s")
def sliding_mean_knee(t):
    """The knee is looked for in one priority's curve: a single curve is inherently one ordered sequence."""
    curve = t.orders.filter("o_orderpriority = '1-URGENT'")
    w = W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    x = F.col("o_totalprice")
    return curve.select("o_orderkey", F.round(F.avg(x).over(w.rowsBetween(-5, 5)), 4).alias("smooth"), F.round(x - 2 * F.lag(x).over(w) + F.lag(x, 2).over(w), 4).alias("bend"))


@query(f"WITH {ASSAY}, r AS (SELECT cohort, label, feature, sum(value) AS s FROM assay GROUP BY ALL) SELECT cohort, label, feature, round(s / sum(s) OVER (PARTITION BY cohort, feature), 6) AS share FROM r")
def within_stratum_share(t):
    s = t.assay.groupBy("cohort", "label", "feature").agg(F.sum("value").alias("s"))
    return s.select("cohort", "label", "feature", r6(F.col("s") / F.sum("s").over(W.partitionBy("cohort", "feature")), "share"))


@query("SELECT l_orderkey, l_linenumber, k = 1 AS first_seen FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_orderkey, l_linenumber) AS k FROM lineitem)")
def seen_set_first(t):
    """Ordered units claim a key on first sight: a priority window instead of a running set."""
    w = W.partitionBy("l_partkey").orderBy("l_returnflag", "l_orderkey", "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.row_number().over(w) == 1).alias("first_seen"))
