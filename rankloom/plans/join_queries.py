"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.plans.base import query, r6
from rankloom.sources.relations import ASSAY


def one_to_one_violations(a, b, key: str):
    """Keys that are repeated on a side or missing on one: a validated join expects no row. Counts are pre-aggregated."""
    ca, cb = a.groupBy(key).agg(F.count(F.lit(1)).alias("n_left")), b.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return ca.join(cb, key, "full").select(key, n("n_left").alias("n_left"), n("n_right").alias("n_right")).filter("n_left <> 1 OR n_right <> 1")


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity AS qty, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = o.o_orderstatus")
def inner_multi_key(t):
    li, o = t.lineitem, t.orders
    return li.join(o, (li.l_orderkey == o.o_orderkey) & (li.l_linestatus == o.o_orderstatus)).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), "o_orderstatus")


@query("WITH s AS (SELECT o_custkey AS k, sum(o_totalprice) AS spend FROM orders GROUP BY 1), u AS (SELECT o_custkey AS k, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT c_custkey, n_name, r_name, round(spend, 2) AS spend, coalesce(urgent, 0) AS urgent FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN s ON c_custkey = s.k LEFT JOIN u ON c_custkey = u.k")
def left_evidence_chain(t):
    spend = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spend"), F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("urgent"))
    n, r = t.nation, t.region
    j = t.customer.join(n, F.col("c_nationkey") == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left").join(spend, "c_custkey", "left")
    return j.select("c_custkey", "n_name", "r_name", F.round("spend", 2).alias("spend"), F.coalesce("urgent", F.lit(0)).alias("urgent"))


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS n_old FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n_new FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, n_old::DOUBLE AS n_old, n_new::DOUBLE AS n_new FROM a FULL JOIN b ON a.k = b.k")
def full_outer_old_new(t):
    side = lambda s, n: t.orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias(n))
    return side("F", "n_old").join(side("O", "n_new"), "k", "full")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_eligible(t):
    big = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_no_leak(t):
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@query("WITH hit AS (SELECT doc_id, source FROM documents WHERE doc_id % 100 = 0), touched AS (SELECT DISTINCT source FROM hit) SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM touched) AND lang = 'en'")
def transitive_group_exclusion(t):
    """Excluded seeds take their whole groups along: two equi-joins, no OR condition."""
    d = t.documents.select("doc_id", "source", "lang")
    touched = d.filter("doc_id % 100 = 0").select("source").distinct()
    return d.join(touched, "source", "left_anti").filter("lang = 'en'").select("doc_id")


@query("SELECT a.l_orderkey AS id, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def self_pairs_same_id(t):
    """Pairs within one order, at most seven lines each."""
    a, b = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("i")), t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("j"))
    return a.join(b, "id").filter("i < j")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_nationkey <= b.n_nationkey")
def crossjoin_unit_pairs(t):
    """Combinations with replacement of the units, a table of fixed size."""
    a, b = t.nation.select(F.col("n_nationkey").alias("a")), t.nation.select(F.col("n_nationkey").alias("b"))
    return a.join(F.broadcast(b), F.col("a") <= F.col("b"))


@query("WITH e AS (SELECT vec_id, label, vec_id % 4 AS cohort FROM embeddings) SELECT cohort, count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0) AS pairs FROM e GROUP BY cohort")
def pos_neg_pairs_in_stratum(t):
    """Positive-negative pairs per stratum, counted and never listed."""
    n = lambda k: F.count(F.when(F.col("label") == k, 1))
    return t.embeddings.groupBy((F.col("vec_id") % 4).alias("cohort")).agg((n(1) * n(0)).alias("pairs"))


@query("WITH a AS (SELECT doc_id, count(*) AS n_left FROM documents GROUP BY 1), b AS (SELECT doc_id, count(*) AS n_right FROM labels GROUP BY 1) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE coalesce(n_left, 0) <> 1 OR coalesce(n_right, 0) <> 1")
def validate_one_to_one(t):
    return one_to_one_violations(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")


@query(f"WITH {ASSAY}, s AS (SELECT cohort, feature FROM assay WHERE value > 0.3 GROUP BY 1, 2) SELECT feature FROM s GROUP BY feature HAVING count(*) = (SELECT count(DISTINCT cohort) FROM s)")
def intersect_features(t):
    s = t.assay.filter("value > 0.3").select("cohort", "feature").distinct()
    total = s.agg(F.countDistinct("cohort").alias("_t"))
    return s.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), F.col("n") == F.col("_t")).select("feature")


@query("SELECT doc_id AS id, text AS body, NULL AS url FROM documents UNION ALL SELECT page_id, html, url FROM pages")
def union_by_name_ragged(t):
    a = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    b = t.pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("body"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def except_variant_genes(t):
    return t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct().join(t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def intersect_keys(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).intersect(t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")))


@query("WITH s AS (SELECT DISTINCT p_brand AS a, p_size AS x FROM part), n AS (SELECT a, count(*) AS n FROM s GROUP BY a), c AS (SELECT l.a, r.a AS b, count(*) AS k FROM s l JOIN s r ON l.x = r.x AND l.a < r.a GROUP BY 1, 2) SELECT c.a, c.b, round(k / (na.n + nb.n - k), 6) AS jaccard FROM c JOIN n na ON na.a = c.a JOIN n nb ON nb.a = c.b")
def jaccard_all_pairs(t):
    """Jaccard of the sets of a fixed family (brands): co-occurrence counts on the shared member."""
    s = t.part.select(F.col("p_brand").alias("a"), F.col("p_size").alias("x")).distinct()
    n = s.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    c = s.join(s.select(F.col("a").alias("b"), "x"), "x").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    j = c.join(n.withColumnRenamed("n", "na"), "a").join(n.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", r6(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), "jaccard"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_pairs(t):
    return t.documents.select("lang", "source").distinct()


@query("WITH p AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), a AS (SELECT l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS k FROM p) WHERE k = 1), b AS (SELECT l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) AS k FROM p) WHERE k = 1) SELECT a.l_suppkey, a.l_partkey FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey")
def mutual_best_join(t):
    from rankloom.operators.ranks import top_n

    p = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    a = top_n(p, "l_suppkey", [F.desc("q"), F.col("l_partkey")], 1).select("l_suppkey", "l_partkey")
    b = top_n(p, "l_partkey", [F.desc("q"), F.col("l_suppkey")], 1).select("l_suppkey", "l_partkey")
    return a.join(b, ["l_suppkey", "l_partkey"])
