"""Null models with the replicates that a p value needs: enrichment, rewired graphs, null effects; array background."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rankloom.operators import nulls as N
from rankloom.operators.background import adjust
from rankloom.operators.enrichment import preranked
from rankloom.operators.rewiring import rewire
from rankloom.plans.base import query
from rankloom.plans.model_queries import vectors

REPS = 1000


@query()
def gsea_preranked(t):
    """Brands and sizes as sets over all brand-and-size features, ranked by how two halves of the donors differ: NES, p, FDR, leading edge."""
    arm = lambda k: F.avg(F.when(F.col("donor") % 2 == k, F.col("n")))
    each = t.counts.groupBy("kind", "feature").agg((arm(0) - arm(1)).alias("x")).withColumn("name", F.concat_ws("/", "kind", F.col("feature").cast("string")))
    sets = F.explode(F.array(F.concat(F.lit("kind "), "kind"), F.concat(F.lit("size "), F.col("feature").cast("string")))).alias("set_id")
    out = preranked(each.select(F.col("name").alias("feature"), F.round("x", 9).alias("x")), each.select(sets, F.col("name").alias("feature")), reps=REPS)
    return out.select("set_id", "size", F.round("es", 6).alias("es"), F.round("nes", 6).alias("nes"), F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"), F.round("tag", 6).alias("tag"), "leading_edge")


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS a, 1000000000 + o_custkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node")
def rewired_degrees(t):
    """Degrees of the graph of suppliers and customers after ten swaps an edge: those of the graph as it was."""
    e = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("a"), (F.lit(1_000_000_000) + F.col("o_custkey")).alias("b"), F.lit(1.0).alias("weight"))
    out, _ = rewire(e, swap_factor=10)
    return out.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query()
def null_effect_direction(t):
    """Mean cosine between the cohorts' case-control shifts against 1,000 rotations of residuals, control splits and label permutations."""
    rows = vectors(t).filter("label IN (0, 1)").select("cohort", "sample", "label", "x")
    sizes = {r["cohort"]: (r["n1"], r["n0"]) for r in rows.groupBy("cohort").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).collect()}  # cohorts
    split = {c: max(2, min(n1, n0 // 2)) / max(n0, 1) for c, (n1, n0) in sizes.items()}
    mixed = {c: n1 / (n1 + n0) for c, (n1, n0) in sizes.items()}
    turned = N.rotation_null(rows, "cohort", "label", "sample", reps=REPS).select(F.lit("rotation").alias("kind"), "rep", "cohort", "shift")
    parts = N.split_null(rows.filter("label = 0"), "cohort", "sample", split, reps=REPS, seed=2).select(F.lit("control_split").alias("kind"), "rep", "cohort", "shift")
    labels = N.split_null(rows, "cohort", "sample", mixed, reps=REPS, seed=3).select(F.lit("label_permutation").alias("kind"), "rep", "cohort", "shift")
    every = turned.union(parts).union(labels).filter("shift IS NOT NULL")

    def cosine(g: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(g["shift"].to_numpy())
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        n = len(m)
        c = ((m.sum(axis=0) ** 2).sum() - n) / (n * (n - 1)) if n > 1 else None
        return pd.DataFrame({"kind": g["kind"].iloc[:1], "rep": g["rep"].iloc[:1], "c": [c]})

    each = every.groupBy("kind", "rep").applyInPandas(cosine, "kind string, rep int, c double")  # one vector a cohort
    seen = each.filter("kind = 'rotation' AND rep = 0").select(F.col("c").alias("observed"))
    null = each.filter("rep > 0 AND c IS NOT NULL").crossJoin(F.broadcast(seen))  # one row
    out = null.groupBy("kind").agg(F.max("observed").alias("o"), F.avg("c").alias("m"), F.percentile("c", F.lit(0.95)).alias("q"), ((1 + F.count_if(F.col("c") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"), F.count(F.lit(1)).alias("reps"))
    return out.select("kind", "reps", F.round("o", 6).alias("observed"), F.round("m", 6).alias("null_mean"), F.round("q", 6).alias("null_q95"), F.round("p", 6).alias("p"))


@query()
def rma_background(t):
    """Order totals as intensities, one array per priority: background-adjusted values of every row."""
    return adjust(t.cases.select("sample", "cohort", "score"), ["cohort"], "score").select("sample", "cohort", F.round("adjusted", 3).alias("adjusted"))
