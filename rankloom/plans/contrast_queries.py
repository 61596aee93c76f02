"""Group contrasts with exact or sampled permutation, metric bundles, co-expression averaged over cohorts."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import matrix as M
from rankloom.operators import statistics as T
from rankloom.operators.replicates import cutoffs, weighted_sums, word_sql
from rankloom.operators.signatures import full_ranks
from rankloom.plans import stat_queries as S
from rankloom.plans.base import ORACLES, query, r6
from rankloom.plans.resample_queries import N_PERM
from rankloom.sources.relations import ASSAY, RANKED


@query(f"SELECT a.cohort, n_pos, n_neg, a.auroc, b.auroc AS adj_auroc, c.auroc AS auroc_ws FROM ({ORACLES['auroc']}) a JOIN ({ORACLES['auroc_adjusted']}) b ON a.cohort = b.cohort JOIN ({ORACLES['auroc_stratified']}) c ON a.cohort = c.cohort")
def cell_metrics(t):
    """Counts, AUROC raw, covariate-adjusted and within strata of each cohort, side by side."""
    adjusted, within = (f(t).withColumnRenamed("auroc", name) for f, name in ((S.auroc_adjusted, "adj_auroc"), (S.auroc_stratified, "auroc_ws")))
    return S.auroc(t).join(adjusted, "cohort").join(within, "cohort")


_BEST = "row_number() OVER (PARTITION BY f ORDER BY round(w, 9) DESC, g) AS k"


@query(
    f"WITH {ASSAY}, k AS (SELECT cohort, sample, feature, rank() OVER (PARTITION BY cohort, feature ORDER BY value) + (count(*) OVER (PARTITION BY cohort, feature, value) - 1) / 2 AS rk FROM assay), "
    "r AS (SELECT a.cohort, a.feature AS f, b.feature AS g, corr(a.rk, b.rk) AS r FROM k a JOIN k b ON a.sample = b.sample AND a.feature <> b.feature GROUP BY 1, 2, 3), "
    f"z AS (SELECT f, g, abs(tanh(avg(atanh(greatest(-0.999999, least(0.999999, r)))))) AS w FROM r GROUP BY 1, 2), t AS (SELECT f, g, w FROM (SELECT *, {_BEST} FROM z) WHERE k <= 4) "
    "SELECT least(f, g) AS a, greatest(f, g) AS b, round(max(w), 6) AS weight FROM t GROUP BY 1, 2"
)
def coexpression_edges(t, k: int = 4):
    """Rank correlations of all features by cohort as one blocked product, averaged over cohorts by Fisher's z; each feature's k strongest partners become edges."""
    ranked = T.spread_rank(t.assay, ["cohort", "feature"], "value", "rk")
    rows = ranked.groupBy("cohort", "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "rk"))), lambda v: v["rk"]).alias("x"))
    wide = M.width_of(t.embeddings, "embedding")
    e = M.entries(M.products(rows, ["cohort"], wide), ["cohort"], wide)
    n = e.filter("j = 0").select("cohort", F.col("v").alias("n"))
    one = e.filter("i = j AND i > 0").select("cohort", F.col("i").alias("f"), F.col("v").alias("ss")).join(e.filter("i = 0 AND j > 0").select("cohort", F.col("j").alias("f"), F.col("v").alias("s")), ["cohort", "f"])
    left, right = (one.select("cohort", F.col("f").alias(c), F.col("ss").alias(f"ss_{c}"), F.col("s").alias(f"s_{c}")) for c in "fg")
    each = e.filter("0 < i AND i < j").select("cohort", F.col("i").alias("f"), F.col("j").alias("g"), "v").join(left, ["cohort", "f"]).join(right, ["cohort", "g"]).join(n, "cohort")
    spread = lambda c: F.sqrt(F.col("n") * F.col(f"ss_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}"))
    r = (F.col("n") * F.col("v") - F.col("s_f") * F.col("s_g")) / (spread("f") * spread("g"))
    z = each.withColumn("z", F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r)))).groupBy("f", "g").agg(F.abs(F.tanh(F.avg("z"))).alias("w"))
    both = z.union(z.select(F.col("g"), F.col("f"), "w"))
    best = both.withColumn("k", F.row_number().over(W.partitionBy("f").orderBy(F.desc(F.round("w", 9)), "g"))).filter(F.col("k") <= k)
    return best.groupBy(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b")).agg(r6(F.max("w"), "weight"))


def assignments(n: int, n_a: int, most: int) -> np.ndarray | None:
    """All ways to put n_a of n rows in the first arm but the observed one (the first n_a), if there are at most `most` in all; else None."""
    if math.comb(n, n_a) > most:
        return None
    rows = [c for c in itertools.combinations(range(n), n_a) if c != tuple(range(n_a))]
    out = np.zeros((len(rows), n), bool)
    for k, c in enumerate(rows):
        out[k, list(c)] = True
    return out


def group_contrast(rows, key: str, row: str, arm: str, value: str, n_perm: int = N_PERM, seed: str = "contrast"):
    """key, n_a, n_b, mean_a, mean_b, delta, hedges_g, auroc, p_perm of arm 1 against arm 0 for every key; keys with under two rows in an arm are left out.

    Labels are enumerated where there are at most n_perm assignments (then a key has few rows, and one task has them);
    elsewhere n_perm random ones are drawn and summed in one pass over the rows, whatever a key's size.
    """
    clean = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(key, row, F.col(arm).cast("int").alias("arm"), F.col(value).cast("double").alias("value"))
    stats = T.arms(clean, key, F.col("arm")).filter("n1 >= 2 AND n0 >= 2")
    sizes = {r[key]: (r["n1"], r["n0"], r["m1"] - r["m0"]) for r in stats.collect()}  # one row a contrast
    small = [k for k, (a, b, _) in sizes.items() if math.comb(a + b, a) <= n_perm]
    large = [k for k in sizes if k not in small]
    kind = rows.schema[key].dataType.simpleString()

    def enumerate_all(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["arm", row], ascending=[False, True])
        v, n_a = g["value"].to_numpy(), int(g["arm"].sum())
        a = assignments(len(v), n_a, n_perm).astype(float)
        d = a @ v / n_a - (1 - a) @ v / (len(v) - n_a)
        return pd.DataFrame({key: g[key].iloc[:1], "p_perm": [(1 + (np.abs(d) >= abs(sizes[g[key].iloc[0]][2]) - 1e-12).sum()) / (1 + len(d))]})

    tested = clean.filter(F.col(key).isin(small)).groupBy(key).applyInPandas(enumerate_all, f"{key} {kind}, p_perm double")
    if large:
        own = clean.filter(F.col(key).isin(large)).withColumn("x", F.array("value"))
        cut = cutoffs(own, row, {k: sizes[k][0] for k in large}, seed, n_perm, key)
        null = weighted_sums(own, key, row, "x", seed, n_perm, cut).join(stats.select(key, (F.col("m1") - F.col("m0")).alias("seen")), key)
        d = F.col("s")[0] / F.col("n") - (F.col("all_s")[0] - F.col("s")[0]) / (F.col("all_n") - F.col("n"))
        tested = tested.union(null.groupBy(key).agg(((1 + F.count_if(F.abs(d) >= F.abs("seen") - 1e-12)) / (1 + F.count(F.lit(1)))).alias("p_perm")))
    auc = T.auroc(clean, key, y="arm", score="value").select(key, "auroc")
    effect = T.hedges_g(stats, least=2, eps=1e-12)
    return effect.join(auc, key).join(tested, key).select(key, F.col("n1").alias("n_a"), F.col("n0").alias("n_b"), F.col("m1").alias("mean_a"), F.col("m0").alias("mean_b"), (F.col("m1") - F.col("m0")).alias("delta"), "g", "auroc", "p_perm")


_GC = f"v AS (SELECT c_nationkey AS id, avg(c_acctbal) AS v FROM customer GROUP BY 1), c AS (SELECT r_regionkey AS grp, id, v, (n_regionkey = r_regionkey)::INT AS arm FROM v JOIN nation ON n_nationkey = id, region), s AS (SELECT grp, sum(arm) AS n1, count(*) - sum(arm) AS n0, avg(v) FILTER (WHERE arm = 1) AS m1, avg(v) FILTER (WHERE arm = 0) AS m0 FROM c GROUP BY 1 HAVING sum(arm) >= 2 AND count(*) - sum(arm) >= 2), d AS (SELECT c.grp, rep, v, row_number() OVER (PARTITION BY c.grp, rep ORDER BY {word_sql('contrast', 'rep', 'id')}, id) AS k FROM c JOIN s ON c.grp = s.grp, (SELECT unnest(range(0, {N_PERM})) AS rep)), nul AS (SELECT d.grp, rep, avg(v) FILTER (WHERE k <= n1) - avg(v) FILTER (WHERE k > n1) AS d FROM d JOIN s ON d.grp = s.grp GROUP BY 1, 2), p AS (SELECT nul.grp, (1 + sum((abs(d) >= abs(m1 - m0) - 1e-12)::INT)) / (1 + count(*)) AS p FROM nul JOIN s ON nul.grp = s.grp GROUP BY 1)"


@query(f"WITH {_GC}, k AS (SELECT grp, arm, rank() OVER (PARTITION BY grp ORDER BY v) + (count(*) OVER (PARTITION BY grp, v) - 1) / 2 AS rk FROM c), a AS (SELECT grp, (sum(rk) FILTER (WHERE arm = 1) - sum(arm) * (sum(arm) + 1) / 2) / (sum(arm) * (count(*) - sum(arm))) AS auroc FROM k GROUP BY 1) SELECT s.grp, n1::BIGINT AS n_a, n0::BIGINT AS n_b, round(m1 - m0, 4) AS delta, round(auroc, 6) AS auroc, round(p, 6) AS p_perm FROM s JOIN p ON s.grp = p.grp JOIN a ON a.grp = s.grp")
def region_contrast(t):
    """Each region's nations against all others by the mean balance of their customers: effect, AUROC, permutation p."""
    v = t.customer.groupBy(F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("v"))
    own = v.join(t.nation.select(F.col("n_nationkey").alias("id"), "n_regionkey"), "id")
    regions = t.region.select(F.col("r_regionkey").alias("grp"))
    each = own.crossJoin(F.broadcast(regions)).withColumn("arm", (F.col("n_regionkey") == F.col("grp")).cast("int"))  # five regions
    return group_contrast(each, "grp", "id", "arm", "v").select("grp", F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), F.round("delta", 4).alias("delta"), r6("auroc"), r6("p_perm"))


_SETS = {"response_signed": "avg(r) FILTER (WHERE feature <= 6) - avg(r) FILTER (WHERE feature BETWEEN 7 AND 12)", "response_up_only": "avg(r) FILTER (WHERE feature <= 6)", "set_a": "avg(r) FILTER (WHERE feature BETWEEN 13 AND 22)", "set_b": "avg(r) FILTER (WHERE feature BETWEEN 23 AND 30)", "set_a_minus_b": "avg(r) FILTER (WHERE feature BETWEEN 13 AND 22) - avg(r) FILTER (WHERE feature BETWEEN 23 AND 30)"}
_LONG = f"{ASSAY}, {RANKED}, sc AS (SELECT sample, cohort, label, {', '.join(f'round({v}, 9) AS {k}' for k, v in _SETS.items())} FROM ranks GROUP BY 1, 2, 3), long AS (SELECT sample, cohort, label, unnest({list(_SETS)}) AS score, unnest([{', '.join(_SETS)}]) AS v, response_signed AS resp FROM sc)"
_RANK2 = "rank() OVER (PARTITION BY cohort, score ORDER BY {0}) + (count(*) OVER (PARTITION BY cohort, score, {0}) - 1) / 2"
_AUC2 = "(SELECT cohort, score, (sum(rk * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS {0} FROM (SELECT cohort, score, label, " + _RANK2.format("{1}") + " AS rk FROM {2}) GROUP BY 1, 2)"


@query(
    f"WITH {_LONG}, two AS (SELECT * FROM long WHERE label IN (0, 1)), f AS (SELECT cohort, score, regr_slope(resp, v) AS b1, regr_intercept(resp, v) AS a1, regr_slope(v, resp) AS b2, regr_intercept(v, resp) AS a2 FROM two WHERE label = 0 AND score IN ('set_a', 'set_b') GROUP BY 1, 2), "
    "res AS (SELECT two.cohort, two.score, label, round(resp - a1 - b1 * v, 6) AS r1, round(v - a2 - b2 * resp, 6) AS r2 FROM two JOIN f ON two.cohort = f.cohort AND two.score = f.score), "
    f"u AS {_AUC2.format('auroc', 'v', 'two')}, x AS {_AUC2.format('response_adjusted', 'r1', 'res')}, y AS {_AUC2.format('this_adjusted', 'r2', 'res')}, "
    f"s AS (SELECT cohort, score, corr(rv, rr) AS rho FROM (SELECT cohort, score, {_RANK2.format('v')} AS rv, {_RANK2.format('resp')} AS rr FROM long) GROUP BY 1, 2), n AS (SELECT cohort, score, sum(label)::BIGINT AS n_pos, count(*) - sum(label)::BIGINT AS n_ctrl FROM two GROUP BY 1, 2) "
    "SELECT n.cohort, n.score, n_pos, n_ctrl, round(auroc, 6) AS auroc, round(rho, 6) AS rho, round(response_adjusted, 5) AS response_adjusted, round(this_adjusted, 5) AS this_adjusted FROM n JOIN u ON n.cohort = u.cohort AND n.score = u.score JOIN s ON n.cohort = s.cohort AND n.score = s.score LEFT JOIN x ON n.cohort = x.cohort AND n.score = x.score LEFT JOIN y ON n.cohort = y.cohort AND n.score = y.score"
)
def transplanted_scores(t):
    """Sets taken over from elsewhere, scored on ranks in every cohort: AUROC, correlation with the response score, and each adjusted for the other."""
    ranks = full_ranks(t.assay)
    side = lambda a, b: F.avg(F.when(F.col("feature").between(a, b), F.col("r")))
    defs = {"response_signed": side(1, 6) - side(7, 12), "response_up_only": side(1, 6), "set_a": side(13, 22), "set_b": side(23, 30), "set_a_minus_b": side(13, 22) - side(23, 30)}
    sc = ranks.groupBy("sample", "cohort", "label").agg(*(F.round(v, 9).alias(k) for k, v in defs.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("score"), F.col(k).alias("v")) for k in defs))).alias("p")
    long = sc.select("cohort", "label", F.col("response_signed").alias("resp"), pairs).select("cohort", "label", "resp", "p.*")
    keys, two = ["cohort", "score"], long.filter("label IN (0, 1)")
    mutual = two.filter(F.col("score").isin("set_a", "set_b"))
    auc = T.auroc(two, keys, "label", "v").select(*keys, "n_pos", F.col("n_neg").alias("n_ctrl"), r6("auroc"))
    rho = T.spearman(long, keys, "v", "resp").select(*keys, r6("rho"))
    out = auc.join(rho, keys)
    for name, score, covariate in (("response_adjusted", "resp", "v"), ("this_adjusted", "v", "resp")):
        res = T.residual_on_negatives(mutual, keys, "label", score, covariate).withColumn("resid", F.round("resid", 6))
        out = out.join(T.auroc(res, keys, "label", "resid").select(*keys, F.round("auroc", 5).alias(name)), keys, "left")
    return out
