"""Filters, predicates and identifier mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rankloom.operators.quantiles import exact_quantiles
from rankloom.plans.base import query, r6
from rankloom.sources.relations import ASSAY


def condition_map(conditions: dict[str, list]):
    """AND over columns of membership in the allowed values."""
    return reduce(lambda a, b: a & b, (F.col(c).isin(*v) for c, v in conditions.items()))


def first_match(column, rules: list[tuple[str, str]], default=None):
    """Ordered regular-expression rules; the first that matches wins."""
    out = None
    for pattern, label in rules:
        out = F.when(column.rlike(pattern), label) if out is None else out.when(column.rlike(pattern), label)
    return out.otherwise(default)


@query(f"WITH {ASSAY}, m AS (SELECT * FROM assay WHERE (cohort + feature) % 7 <> 3 OR sample % 3 > 0), n AS (SELECT cohort, count(DISTINCT sample) AS n FROM m GROUP BY cohort) SELECT m.cohort, feature, count(*) AS seen FROM m JOIN n ON m.cohort = n.cohort GROUP BY m.cohort, feature, n.n HAVING count(*) = n.n")
def all_measured_features(t):
    m = t.assay.filter(((F.col("cohort") + F.col("feature")) % 7 != 3) | (F.col("sample") % 3 > 0))
    n = m.groupBy("cohort").agg(F.countDistinct("sample").alias("n"))
    return m.groupBy("cohort", "feature").agg(F.count(F.lit(1)).alias("seen")).join(n, "cohort").filter("seen = n").drop("n")


@query(f"WITH {ASSAY}, m AS (SELECT * FROM assay WHERE (cohort + feature) % 5 <> 0) SELECT feature, count(DISTINCT cohort) AS n_cohorts FROM m GROUP BY feature HAVING count(DISTINCT cohort) >= 0.8 * (SELECT count(DISTINCT cohort) FROM m)")
def coverage_threshold(t):
    m = t.assay.filter((F.col("cohort") + F.col("feature")) % 5 != 0).select("cohort", "feature").distinct()
    total = m.agg(F.countDistinct("cohort").alias("_t"))
    return m.groupBy("feature").agg(F.count(F.lit(1)).alias("n_cohorts")).join(F.broadcast(total), F.col("n_cohorts") >= 0.8 * F.col("_t")).drop("_t")


@query(f"WITH {ASSAY} SELECT feature, round(avg((value > 0)::INT), 6) AS detected FROM assay GROUP BY feature HAVING avg((value > 0)::INT) >= 0.5")
def detect_fraction(t):
    return t.assay.groupBy("feature").agg(F.avg((F.col("value") > 0).cast("double")).alias("d")).filter("d >= 0.5").select("feature", r6("d", "detected"))


@query("WITH a AS (SELECT p_partkey, unnest([p_name, p_brand || '/' || p_size, p_brand]) AS alias FROM part), o AS (SELECT DISTINCT p_brand AS alias FROM part), u AS (SELECT alias, min(p_partkey) AS p_partkey FROM a WHERE alias NOT IN (SELECT alias FROM o) GROUP BY alias HAVING count(DISTINCT p_partkey) = 1) SELECT alias, p_partkey FROM u")
def alias_unique_resolution(t):
    """Aliases that name exactly one identifier and are no official name themselves."""
    a = t.part.select("p_partkey", F.explode(F.array("p_name", F.concat_ws("/", "p_brand", "p_size"), "p_brand")).alias("alias"))
    official = t.part.select(F.col("p_brand").alias("alias")).distinct()
    return a.join(official, "alias", "left_anti").groupBy("alias").agg(F.min("p_partkey").alias("p_partkey"), F.max("p_partkey").alias("hi")).filter("p_partkey = hi").drop("hi")


@query("WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]{2,}'), lambda x: x <> '')) AS ids FROM documents) SELECT doc_id, ids[1] AS id FROM d WHERE len(ids) = 1")
def multi_id_probe_to_single(t):
    ids = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]{2,}"), 0))
    return t.documents.select("doc_id", ids.alias("ids")).filter(F.size("ids") == 1).select("doc_id", F.get("ids", F.lit(0)).alias("id"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^PROMO') THEN 'promo' WHEN regexp_matches(p_type, 'BRUSHED|POLISHED') THEN 'finished' WHEN regexp_matches(p_type, 'STEEL$') THEN 'steel' ELSE 'other' END AS class FROM part")
def rule_classifier_first_match(t):
    return t.part.select("p_partkey", first_match(F.col("p_type"), [("^PROMO", "promo"), ("BRUSHED|POLISHED", "finished"), ("STEEL$", "steel")], "other").alias("class"))


@query("SELECT c_custkey, nullif(regexp_extract(c_name, '^([A-Za-z]+)', 1), '') AS prefix, TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS number FROM customer")
def structured_id_parse(t):
    return t.customer.select("c_custkey", F.nullif(F.regexp_extract("c_name", "^([A-Za-z]+)", 1), F.lit("")).alias("prefix"), F.expr("try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS bigint)").alias("number"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def key_value_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '5-LOW' THEN 0 END AS level FROM orders")
def ordinal_recode(t):
    scale = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 1, "5-LOW": 0}
    m = F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])
    return t.orders.select("o_orderkey", F.try_element_at(m, F.col("o_orderpriority")).alias("level"))


@query("SELECT l_orderkey, l_linenumber, (l_returnflag IN ('A', 'R') AND l_linestatus = 'F')::INT AS in_a, (l_returnflag = 'N' AND l_linestatus IN ('O', 'F'))::INT AS in_b FROM lineitem WHERE (l_returnflag IN ('A', 'R') AND l_linestatus = 'F') <> (l_returnflag = 'N' AND l_linestatus IN ('O', 'F'))")
def condition_map_exclusive(t):
    a, b = condition_map({"l_returnflag": ["A", "R"], "l_linestatus": ["F"]}), condition_map({"l_returnflag": ["N"], "l_linestatus": ["O", "F"]})
    return t.lineitem.filter(a != b).select("l_orderkey", "l_linenumber", a.cast("int").alias("in_a"), b.cast("int").alias("in_b"))


_AUDIT = f"{ASSAY}, a AS (SELECT cohort, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean, median(value) AS med, quantile_cont(value, 0.99) AS p99, avg((value < 0)::INT) AS neg, avg((value = floor(value))::INT) AS whole FROM assay GROUP BY cohort)"


def _audit(t):
    v = F.col("value")
    plain = t.assay.groupBy("cohort").agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.avg((v < 0).cast("double")).alias("neg"), F.avg((v == F.floor(v)).cast("double")).alias("whole"))
    q = exact_quantiles(t.assay, ["cohort"], "value", [0.5, 0.99]).select("cohort", F.col("q")[0].alias("med"), F.col("q")[1].alias("p99"))
    return plain.join(q, "cohort")


@query(f"WITH {_AUDIT} SELECT cohort, n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 6) AS mean, round(med, 6) AS med, round(p99, 6) AS p99, round(neg, 6) AS neg, round(whole, 6) AS whole FROM a")
def scale_audit(t):
    return _audit(t).select("cohort", "n", *(r6(c) for c in ("lo", "hi", "mean", "med", "p99", "neg", "whole")))


@query(f"WITH {_AUDIT} SELECT cohort, CASE WHEN neg > 0.2 THEN 'centred' WHEN whole > 0.99 THEN 'counts' WHEN p99 > 100 THEN 'linear' ELSE 'log' END AS scale FROM a")
def scale_classify(t):
    return _audit(t).select("cohort", F.when(F.col("neg") > 0.2, "centred").when(F.col("whole") > 0.99, "counts").when(F.col("p99") > 100, "linear").otherwise("log").alias("scale"))


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[a-z]+\\.[0-9]+@')) AS ref FROM documents")
def xref_extract_all(t):
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+\.[0-9]+@"), 0)).alias("ref")).distinct()


@query("SELECT doc_id, coalesce(nullif(trim(lang), ''), nullif(trim(source), ''), 'none') AS tag, lower(trim(lang)) IN ('en', 'de') AS flag FROM documents")
def coalesce_chain(t):
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return t.documents.select("doc_id", F.coalesce(blank("lang"), blank("source"), F.lit("none")).alias("tag"), F.lower(F.trim("lang")).isin("en", "de").alias("flag"))


@query("WITH g AS (SELECT o_custkey AS grp, min(o_orderkey) AS first FROM orders GROUP BY 1) SELECT grp, row_number() OVER (ORDER BY first) - 1 AS code FROM g")
def relabel_by_first_appearance(t):
    """Dense codes in order of first appearance: ranks by range partition, so no task sorts all groups."""
    from rankloom.operators.ordering import global_rank

    g = t.orders.groupBy(F.col("o_custkey").alias("grp")).agg(F.min("o_orderkey").alias("first"))
    return global_rank(g, "first", "code").select("grp", "code")
