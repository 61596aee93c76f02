"""Graphs, duplicate audits, folds and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators.components import connected_components as components
from rankloom.operators.nearest import nearest
from rankloom.plans.base import query, r6
from rankloom.sources.shared import materialize

_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)"
_COS = f"{_V}, pr AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e) / (a.l * b.l), 6) AS w FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"


def _nearest(t, k, queries=None):
    """The k nearest of all vectors to the query vectors; the queries are those with an id divisible by 50, or the ids given."""
    v = t.embeddings.select(F.col("vec_id").alias("sample"), F.col("embedding").alias("x"))
    q = v.filter("sample % 50 = 0") if queries is None else v.join(queries, "sample", "left_semi")
    return nearest(v, q, k)


@query(f"WITH {_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS k FROM pr) SELECT i, j, w FROM k WHERE k <= 5")
def knn_edges(t):
    """The five nearest of all vectors to each query vector, exactly."""
    return _nearest(t, 5)


@query(f"WITH {_COS}, b AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS k FROM pr) WHERE k = 1), back AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e) / (a.l * b.l), 6) AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT j FROM b)), bb AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS k FROM back) WHERE k = 1) SELECT b.i, b.j, b.w FROM b JOIN bb ON b.i = bb.j AND b.j = bb.i")
def mutual_best_pairs(t):
    """Queries whose best match has them as its own best match; the matches search all vectors in turn."""
    b = materialize(_nearest(t, 1), "best-matches")
    back = _nearest(t, 1, b.select(F.col("j").alias("sample")).distinct())
    return b.join(back.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"])


@query(f"WITH {_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS k, w - lead(w) OVER (PARTITION BY i ORDER BY w DESC, j) AS gap FROM pr) SELECT i, j, CASE WHEN w >= 0.5 THEN 'same' WHEN w >= 0.35 AND gap >= 0.02 THEN 'likely' ELSE 'no' END AS call FROM k WHERE k = 1")
def duplicate_calls(t):
    """Each query's best match of all vectors, and whether it is clear enough to be the same specimen."""
    two = _nearest(t, 2).groupBy("i").agg(F.max_by("j", F.struct("w", -F.col("j"))).alias("j"), F.max("w").alias("w"), F.min("w").alias("next"), F.count(F.lit(1)).alias("n"))
    gap = F.when(F.col("n") > 1, F.col("w") - F.col("next"))
    return two.select("i", "j", F.when(F.col("w") >= 0.5, "same").when((F.col("w") >= 0.35) & (gap >= 0.02), "likely").otherwise("no").alias("call"))


_LINKS = "SELECT DISTINCT least(d1.doc_id, d2.doc_id) AS a, greatest(d1.doc_id, d2.doc_id) AS b FROM (SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY 2) d1 JOIN (SELECT doc_id, md5(text) AS h FROM documents) d2 ON d1.h = d2.h AND d1.doc_id <> d2.doc_id"


@query(f"WITH RECURSIVE e AS ({_LINKS}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM s UNION SELECT s.b, r.seen FROM r JOIN s ON s.a = r.node) SELECT node, min(seen) AS component FROM r GROUP BY node")
def connected_components(t):
    """Copies linked to their first copy (a star, never all pairs), plus what the links reach."""
    d = t.documents.select("doc_id", F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    links = d.join(first, "h").filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(links)
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())


_EDGES = "e AS (SELECT DISTINCT least(l_suppkey, l_partkey % 97) AS a, greatest(l_suppkey, l_partkey % 97) AS b FROM lineitem WHERE l_suppkey <> l_partkey % 97 AND l_quantity > 45), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), deg AS (SELECT a AS node, count(*) AS degree FROM s GROUP BY 1)"


def _edges(t):
    m = F.col("l_partkey") % 97
    e = t.lineitem.filter((F.col("l_quantity") > 45) & (F.col("l_suppkey") != m)).select(F.least("l_suppkey", m).alias("a"), F.greatest("l_suppkey", m).alias("b")).distinct()
    return e.union(e.select("b", "a")).toDF("a", "b")


@query(f"WITH {_EDGES} SELECT degree, count(*) AS nodes FROM deg GROUP BY degree")
def degree_summary(t):
    return _edges(t).groupBy("a").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"WITH {_EDGES}, w AS (SELECT s.a, s.b, 1 / sqrt(x.degree * y.degree) AS w FROM s JOIN deg x ON s.a = x.node JOIN deg y ON s.b = y.node), h1 AS (SELECT b AS node, sum(w) AS v FROM w WHERE a <= 5 GROUP BY 1), h2 AS (SELECT w.b AS node, sum(h1.v * w.w) AS v FROM h1 JOIN w ON w.a = h1.node GROUP BY 1) SELECT node, round(v, 6) AS v FROM h2")
def diffusion_two_hop(t):
    """Two hops of the normalised adjacency from a seed set."""
    s = _edges(t)
    deg = s.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    w = s.join(deg.withColumnRenamed("d", "da"), "a").join(deg.select(F.col("a").alias("b"), F.col("d").alias("db")), "b").select("a", "b", (1 / F.sqrt(F.col("da") * F.col("db"))).alias("w"))
    h1 = w.filter("a <= 5").groupBy(F.col("b").alias("a")).agg(F.sum("w").alias("v"))
    return h1.join(w, "a").groupBy(F.col("b").alias("node")).agg(r6(F.sum(F.col("v") * F.col("w")), "v"))


@query(f"WITH {_EDGES}, n AS (SELECT DISTINCT node FROM deg WHERE node % 3 = 0), i AS (SELECT s.a, s.b FROM s JOIN n x ON s.a = x.node JOIN n y ON s.b = y.node) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM i WHERE a < b) AS edges, round(1 - (SELECT count(DISTINCT a) FROM i) / (SELECT count(*) FROM n), 6) AS isolated")
def induced_subgraph(t):
    s = _edges(t)
    n = s.filter("a % 3 = 0").agg(F.countDistinct("a").alias("nodes"))
    i = s.filter("a % 3 = 0 AND b % 3 = 0").agg(F.count_if(F.expr("a < b")).alias("edges"), F.countDistinct("a").alias("linked"))
    return n.join(F.broadcast(i)).select("nodes", "edges", r6(1 - F.col("linked") / F.col("nodes"), "isolated"))


@query("WITH g AS (SELECT md5(text) AS h, doc_id FROM documents), p AS (SELECT h, count(DISTINCT quality) AS nq, count(*) AS n FROM g JOIN labels ON g.doc_id = labels.doc_id GROUP BY h) SELECT h, n, nq FROM p WHERE nq > 1")
def label_conflicts(t):
    g = t.documents.select("doc_id", F.md5("text").alias("h")).join(t.labels.select("doc_id", "quality"), "doc_id")
    return g.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("quality").alias("nq")).filter("nq > 1").select("h", "n", "nq")


@query("WITH s AS (SELECT quality = 1 AS a, toxic = 0 AS b FROM labels) SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS agreement, sum((a AND NOT b)::BIGINT)::BIGINT AS a_only, sum((b AND NOT a)::BIGINT)::BIGINT AS b_only FROM s")
def agreement_rates(t):
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    return t.labels.agg(F.count(F.lit(1)).alias("n"), r6(F.avg((a == b).cast("double")), "agreement"), F.count_if(a & ~b).alias("a_only"), F.count_if(b & ~a).alias("b_only"))


_FOLDS = "s AS (SELECT vec_id AS sample, vec_id % 4 AS cohort, vec_id // 8 AS dup FROM embeddings), c AS (SELECT DISTINCT cohort AS test_cohort FROM s), tg AS (SELECT DISTINCT cohort AS test_cohort, dup FROM s WHERE sample % 5 = 0), f AS (SELECT c.test_cohort, s.sample, s.dup, CASE WHEN s.cohort = c.test_cohort THEN 'test' ELSE 'train' END AS split FROM s, c WHERE s.cohort = c.test_cohort OR NOT EXISTS (SELECT 1 FROM tg WHERE tg.test_cohort = c.test_cohort AND tg.dup = s.dup))"


def _folds(t):
    """Leave-one-cohort-out folds; training samples that share a marked duplicate group with the test cohort are dropped."""
    s = t.embeddings.select(F.col("vec_id").alias("sample"), (F.col("vec_id") % 4).alias("cohort"), F.floor(F.col("vec_id") / 8).alias("dup"))
    touched = s.filter("sample % 5 = 0").select(F.col("cohort").alias("test_cohort"), "dup").distinct()
    each = s.withColumn("test_cohort", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])))
    test = each.filter("cohort = test_cohort").select("test_cohort", "sample", "dup", F.lit("test").alias("split"))
    train = each.filter("cohort <> test_cohort").join(touched, ["test_cohort", "dup"], "left_anti").select("test_cohort", "sample", "dup", F.lit("train").alias("split"))
    return test.union(train)


@query(f"WITH {_FOLDS} SELECT test_cohort, sample, split FROM f")
def loco_folds(t):
    return _folds(t).select("test_cohort", "sample", "split")


@query(f"WITH {_FOLDS}, x AS (SELECT test_cohort, dup FROM f WHERE split = 'test' AND sample % 5 = 0) SELECT f.test_cohort, f.sample FROM f JOIN x ON f.test_cohort = x.test_cohort AND f.dup = x.dup WHERE split = 'train'")
def fold_leakage_zero_rows(t):
    """Invariant: no training sample shares a marked group with its test cohort; expects no row."""
    f = _folds(t)
    marked = f.filter("split = 'test' AND sample % 5 = 0").select("test_cohort", "dup").distinct()
    return f.filter("split = 'train'").join(marked, ["test_cohort", "dup"], "left_semi").select("test_cohort", "sample")


@query("SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(DISTINCT o_custkey) > 1")
def unique_value_per_group(t):
    return t.orders.groupBy("o_orderkey").agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi")).filter("lo <> hi").select("o_orderkey")


@query("SELECT lang, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', doc_id, text)), 1, 15))::HUGEINT)::VARCHAR AS digest FROM documents GROUP BY lang")
def content_digest(t):
    """Order-free content hash of each group, for provenance and frozen-input checks: a sum, so nothing is gathered or sorted."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text")), 1, 15), 16, 10).cast("decimal(38,0)")
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("digest"))
