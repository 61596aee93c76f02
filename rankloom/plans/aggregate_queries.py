"""Aggregations, pivots, grouping levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators.quantiles import exact_quantiles
from rankloom.plans.base import query, r6
from rankloom.sources.relations import ASSAY, COUNTS


@query(f"WITH {ASSAY}, v AS (SELECT feature // 8 AS symbol, feature, var_samp(value) AS v FROM assay GROUP BY 1, 2) SELECT symbol, feature, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, feature) AS k FROM v) WHERE k = 1")
def collapse_max_variance(t):
    v = t.assay.groupBy(F.floor(F.col("feature") / 8).alias("symbol"), "feature").agg(F.var_samp("value").alias("v"))
    best = v.groupBy("symbol").agg(F.max_by(F.struct("feature", "v"), F.struct("v", -F.col("feature"))).alias("b"))
    return best.select("symbol", "b.feature", r6("b.v", "v"))


@query("SELECT l_partkey, l_suppkey, sum(l_quantity)::DOUBLE AS qty, max(l_discount) AS disc FROM lineitem GROUP BY 1, 2")
def sum_duplicates(t):
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("disc"))


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_quantity) AS w FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def edge_max_weight(t):
    return t.lineitem.filter("l_partkey <> l_suppkey").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.max("l_quantity").alias("w"))


@query("WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, string_agg(o_orderpriority || '=' || n, ';' ORDER BY n DESC, o_orderpriority) AS breakdown FROM c GROUP BY 1")
def breakdown_string(t):
    c = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    s = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "o_orderpriority", "n")))
    return c.groupBy("o_orderstatus").agg(F.array_join(F.transform(s, lambda x: F.concat_ws("=", x["o_orderpriority"], x["n"].cast("string"))), ";").alias("breakdown"))


@query("SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs FROM documents GROUP BY source")
def sorted_distinct_string(t):
    return t.documents.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("langs"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, sum((l_tax = 0)::BIGINT)::BIGINT AS untaxed FROM lineitem GROUP BY 1")
def conditional_counts(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum((F.col("l_tax") == 0).cast("long")).alias("untaxed"))


@query("SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS med, round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 6) AS iqr, round(stddev_pop(c_acctbal), 6) AS sd0, round(stddev_samp(c_acctbal), 6) AS sd1 FROM customer GROUP BY 1")
def quantile_iqr(t):
    q = exact_quantiles(t.customer, ["c_mktsegment"], "c_acctbal", [0.25, 0.5, 0.75]).drop("n")
    a = t.customer.groupBy("c_mktsegment").agg(F.stddev_pop("c_acctbal").alias("s0"), F.stddev_samp("c_acctbal").alias("s1")).join(q, "c_mktsegment")
    return a.select("c_mktsegment", F.col("q")[1].alias("med"), r6(F.col("q")[2] - F.col("q")[0], "iqr"), r6("s0", "sd0"), r6("s1", "sd1"))


@query(f"WITH {ASSAY}, v AS (SELECT cohort, feature, var_samp(value) AS v, count(*) AS n FROM assay GROUP BY 1, 2) SELECT feature, round(sum(v * (n - 1)) / sum(n - 1), 6) AS pooled FROM v GROUP BY 1")
def weighted_pooled_variance(t):
    v = t.assay.groupBy("cohort", "feature").agg(F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return v.groupBy("feature").agg(r6(F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1), "pooled"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_composition(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT l_orderkey, l_linenumber, m AS measure, v AS value FROM (SELECT l_orderkey, l_linenumber, unnest(['qty', 'disc', 'tax']) AS m, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem)")
def unpivot_long(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax")).unpivot(["l_orderkey", "l_linenumber"], ["qty", "disc", "tax"], "measure", "value")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_subset_summary(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::BIGINT AS g1, grouping(o_orderpriority)::BIGINT AS g2 FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"))


@query("SELECT p_brand, p_size::DOUBLE AS p_size, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
def grouping_sets_levels(t):
    p = t.part
    return p.groupingSets([[p.p_brand], [p.p_size], []], p.p_brand, p.p_size).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price")).withColumn("p_size", F.col("p_size").cast("double"))


@query("WITH m AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS a FROM customer GROUP BY 1, 2) SELECT c_mktsegment, count(*) AS n_units, round(avg(a), 6) AS macro FROM m GROUP BY 1")
def macro_average(t):
    m = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("a"))
    return m.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_units"), r6(F.avg("a"), "macro"))


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN (o_totalprice > 150000)::INT END), 6) AS sens, round(avg(CASE WHEN o_orderstatus = 'O' THEN (o_totalprice <= 150000)::INT END), 6) AS spec FROM orders GROUP BY 1")
def sens_spec_at_threshold(t):
    hit = (F.col("o_totalprice") > 150000).cast("double")
    return t.orders.groupBy("o_orderpriority").agg(r6(F.avg(F.when(F.col("o_orderstatus") == "F", hit)), "sens"), r6(F.avg(F.when(F.col("o_orderstatus") == "O", 1 - hit)), "spec"))


@query("SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS segments, min(c_acctbal) AS lo, max(c_acctbal) AS hi, median(c_acctbal) AS med, arg_max(c_custkey, c_acctbal) AS best FROM customer GROUP BY 1")
def named_aggregates(t):
    return t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_mktsegment").alias("segments"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.percentile("c_acctbal", F.lit(0.5)).alias("med"), F.max_by("c_custkey", "c_acctbal").alias("best"))


@query("WITH o AS (SELECT 'ALL' AS level, * FROM orders UNION ALL SELECT o_orderpriority, * FROM orders) SELECT level, o_orderstatus, count(*) AS n FROM o GROUP BY 1, 2")
def marginal_and_detail(t):
    """Overlapping subsets: a fan-out of each row to the levels that it belongs to, combined before the shuffle."""
    o = t.orders.select("o_orderstatus", F.explode(F.array(F.lit("ALL"), "o_orderpriority")).alias("level"))
    return o.groupBy("level", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {COUNTS}, g AS (SELECT donor, kind, count(*) AS n FROM counts GROUP BY 1, 2) SELECT kind, 'donor' AS variable, count(*) AS n_values, max(n) AS top FROM g GROUP BY kind")
def composition_table(t):
    g = t.counts.groupBy("donor", "kind").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("kind").agg(F.lit("donor").alias("variable"), F.count(F.lit(1)).alias("n_values"), F.max("n").alias("top"))
