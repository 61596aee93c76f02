"""Two-sample, correlation, ROC, regression and meta-analysis operators as sums over groups.

Everything reduces to sums that combine on the map side, so a hot group costs a partial aggregate per task; only ranks
need a window. Callers keep the keys; none of these collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.ordering import binned_prefix
from rankloom.operators.ranks import _cols, average_rank


def arms(df: DataFrame, keys, arm: Column, value: str = "value") -> DataFrame:
    """n1 m1 v1 and n0 m0 v0 per key; arm is 1, 0 or null (left out)."""
    side = lambda k: F.when(arm == k, F.col(value))
    return df.groupBy(*_cols(keys)).agg(*(f(side(k)).alias(f"{n}{k}") for k in (1, 0) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))


def pooled_sd() -> Column:
    return F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))


def hedges_g(stats: DataFrame, least: int = 3, eps: float = 0.0) -> DataFrame:
    """g with small-sample correction and its variance; null under `least` values in an arm."""
    n = F.col("n1") + F.col("n0")
    j = F.lit(1.0) - F.lit(3.0) / (4 * n - 9)
    g = F.when((F.col("n1") >= least) & (F.col("n0") >= least), j * (F.col("m1") - F.col("m0")) / (pooled_sd() + eps))
    return stats.withColumn("g", g).withColumn("var_g", n / (F.col("n1") * F.col("n0")) + F.col("g") * F.col("g") / (2 * n))


def welch_t(stats: DataFrame) -> DataFrame:
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return stats.withColumn("t", (F.col("m1") - F.col("m0")) / F.sqrt(a + b)).withColumn("df", (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1)))


def auroc(df: DataFrame, keys, y: str = "y", score: str = "score", out: str = "auroc", many_keys: bool = False) -> DataFrame:
    """Rank-sum AUROC per key, null for one class.

    Scores are counted per distinct value first. Few keys take prefix sums over bins of their range, so a key's values
    are spread over tasks; with many_keys (replicates, samples) one window per key does.
    """
    keys = _cols(keys)
    values = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(y).cast("double").alias("_p"), (F.count(F.lit(1)) - F.sum(y)).cast("double").alias("_q"))
    if many_keys:
        below = F.sum("_q").over(W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1))
        ranked = values.withColumn("before__q", F.coalesce(below, F.lit(0.0)))
    else:
        ranked = binned_prefix(values, keys, score, ["_q"])
    wins = F.col("_p") * (F.col("before__q") + F.col("_q") / 2)
    total = ranked.groupBy(*keys).agg(F.sum(wins).alias("_w"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    return total.select(*keys, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("n_neg"))).alias(out))


def residual_on_negatives(df: DataFrame, keys, y: str = "y", score: str = "score", covariate: str = "covariate", out: str = "resid") -> DataFrame:
    """Score minus the line fitted on covariate among the negatives of each key."""
    keys = _cols(keys)
    fit = df.filter(F.col(y) == 0).groupBy(*keys).agg(F.regr_slope(score, covariate).alias("_b"), F.regr_intercept(score, covariate).alias("_a"))
    return df.join(fit, keys).withColumn(out, F.col(score) - F.col("_a") - F.col("_b") * F.col(covariate)).drop("_a", "_b")


def spread_rank(df: DataFrame, keys, value: str, out: str, base: DataFrame | None = None) -> DataFrame:
    """Average rank for few keys with many rows: counts by distinct value, prefix sums over bins, joined back by value.

    base: the same rows with a shorter plan to count, where df already carries other ranks. Values that are sums of
    doubles must be written first (materialize): made twice, they may differ in the last digit and miss each other.
    """
    keys = _cols(keys)
    counts = (df if base is None else base).groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    ranks = binned_prefix(counts, keys, value, ["_n"]).select(*keys, value, (F.col("before__n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, keys, a: str, b: str, out: str = "rho", many_keys: bool = False) -> DataFrame:
    keys = _cols(keys)
    base = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if many_keys:
        ranked = average_rank(average_rank(base, keys, a, "_ra"), keys, b, "_rb")
    else:
        ranked = spread_rank(spread_rank(base, keys, a, "_ra"), keys, b, "_rb", base)
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias(out), F.count(F.lit(1)).alias("n"))


def bh(df: DataFrame, p: str, keys=(), out: str = "q", parts: int = 1024) -> DataFrame:
    """Benjamini-Hochberg q values per key; a null p has a null q. Computed p values must be written first, as in spread_rank.

    Distinct values take their rank by prefix sums over bins, then fall in bins of equal rank: the least raised value is
    taken inside a bin and over the later bins' minima, so no task holds a key.
    """
    keys = _cols(keys)
    one = df if keys else df.withColumn("_all", F.lit(1))
    names = keys or ["_all"]
    counts = one.filter(F.col(p).isNotNull()).groupBy(*names, p).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    ranked = binned_prefix(counts, names, p, ["_n"]).join(counts.groupBy(*names).agg(F.sum("_n").alias("_m")), names)
    upto = F.col("before__n") + F.col("_n")
    raised = ranked.select(*names, p, (F.col(p) * F.col("_m") / upto).alias("_x"), F.floor((upto - 1) / F.col("_m") * parts).alias("_bin"))
    later = W.partitionBy(*names).orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, -1)
    rest = raised.groupBy(*names, "_bin").agg(F.min("_x").alias("_least")).select(*names, "_bin", F.min("_least").over(later).alias("_later"))
    inside = W.partitionBy(*names, "_bin").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, W.currentRow)
    q = raised.withColumn("_own", F.min("_x").over(inside)).join(rest, [*names, "_bin"]).select(*names, p, F.least(F.lit(1.0), F.col("_own"), F.coalesce("_later", F.lit(1.0))).alias(out))
    return one.join(q, [*names, p], "left").select(*df.columns, out)


def random_effects(df: DataFrame, keys, g: str = "g", v: str = "var_g") -> DataFrame:
    """DerSimonian-Laird mean, standard error, tau squared, I squared and sign share per key; one study keeps its own."""
    keys = _cols(keys)
    w = 1 / F.col(v)
    x = F.col(g)
    s = df.filter(x.isNotNull() & (F.col(v) > 0)).groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"), F.avg((x > 0).cast("double")).alias("share_up"))
    q = F.col("swxx") - F.col("swx") * F.col("swx") / F.col("sw")
    tau = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / (F.col("sw") - F.col("sww") / F.col("sw")))).otherwise(0.0)
    s = s.select(*keys, "k", "share_up", tau.alias("tau2"), F.when((F.col("k") > 1) & (q > 0), F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / q)).otherwise(0.0).alias("i2"))
    each = df.filter(x.isNotNull() & (F.col(v) > 0)).join(s, keys).withColumn("_w", 1 / (F.col(v) + F.col("tau2")))
    return each.groupBy(*keys).agg(F.first("k").alias("k"), F.first("share_up").alias("share_up"), F.first("tau2").alias("tau2"), F.first("i2").alias("i2"), (F.sum(F.col("_w") * x) / F.sum("_w")).alias("mu"), F.sqrt(1 / F.sum("_w")).alias("se"))


def unit_random(*parts) -> Column:
    """Stateless random number in [0, 1) from its parts: the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0
