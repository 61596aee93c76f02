"""Signature scoring over rank relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranks import percentile_rank
from rankloom.operators.statistics import arms, pooled_sd


def full_ranks(assay: DataFrame) -> DataFrame:
    """(r - 1) / (n - 1) within sample; one shuffle by sample."""
    return percentile_rank(assay, "sample").select("sample", "cohort", "label", "feature", "r")


def cohort_effects(ranks: DataFrame, least: int = 3) -> DataFrame:
    """Standardised difference others - control (label 0) per cohort and feature, null under `least` samples in an arm."""
    s = arms(ranks, ["cohort", "feature"], F.when(F.col("label") == 0, 0).otherwise(1), "r")
    effect = F.when((F.col("n1") >= least) & (F.col("n0") >= least), (F.col("m1") - F.col("m0")) / (pooled_sd() + 1e-6))
    return s.select("cohort", "feature", effect.alias("effect"))


def heldout_axis(effects: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(evaluated, feature, axis): mean effect over the other cohorts, features in at least half of them.

    Leave-one-out without a loop or a self-join: per feature one map of its cohorts' effects, and total minus own.
    cohorts is the small table of all cohorts, read without going through the ranks again.
    """
    names = cohorts.select(F.col("cohort").alias("evaluated")).distinct()
    small = F.broadcast(names.join(F.broadcast(names.agg((F.count(F.lit(1)) - 1).alias("n_src")))))
    own = F.map_from_entries(F.collect_list(F.struct("cohort", "effect")))
    each = effects.groupBy("feature").agg(own.alias("own"), F.sum("effect").alias("s"), F.count("effect").alias("n")).join(small)
    mine = F.try_element_at("own", F.col("evaluated"))
    rest = each.select("evaluated", "feature", "n_src", (F.col("s") - F.coalesce(mine, F.lit(0.0))).alias("s"), (F.col("n") - mine.isNotNull().cast("int")).alias("n"))
    return rest.filter((F.col("n") > 0) & (F.col("n") >= F.ceil(F.col("n_src") * 0.5))).select("evaluated", "feature", (F.col("s") / F.col("n")).alias("axis"))


def top_and_bottom(axis: DataFrame, k: int, key: str = "evaluated") -> DataFrame:
    """(key, feature, sign) of the k largest and k smallest; ties by feature. The axis is read once."""
    from rankloom.operators.ranks import ordinal_rank

    both = ordinal_rank(ordinal_rank(axis, key, [F.desc("axis"), F.col("feature")], "_up"), key, [F.col("axis"), F.col("feature")], "_down")
    signs = F.array(F.when(F.col("_up") <= k, 1), F.when(F.col("_down") <= k, -1))
    return both.filter((F.col("_up") <= k) | (F.col("_down") <= k)).select(key, "feature", F.explode(F.filter(signs, lambda x: x.isNotNull())).alias("sign"))


def signed_score(ranks: DataFrame, sets: DataFrame, on: Column | list[str], by: list[str]) -> DataFrame:
    """Mean rank of up features minus mean rank of down features, over those present."""
    j = ranks.join(sets, on)
    side = lambda s: F.avg(F.when(F.col("sign") == s, F.col("r")))
    return j.groupBy(*by).agg((F.coalesce(side(1), F.lit(0.0)) - F.coalesce(side(-1), F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("n_present"))
