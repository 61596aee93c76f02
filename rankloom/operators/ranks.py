"""Rank-family operators over long relations. Ties take the average rank; missing means the row is absent.

Ranks are windows over one sample (or cohort and feature), so a task holds one key at a time; windows that share the
partition share the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.quantiles import exact_quantiles


def _cols(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def average_rank(df: DataFrame, keys, value: str = "value", out: str = "rk") -> DataFrame:
    """Average rank of value within keys, 1-based."""
    keys = _cols(keys)
    first = F.rank().over(W.partitionBy(*keys).orderBy(value))
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, value))
    return df.withColumn(out, first + (ties - 1).cast("double") / 2)


def percentile_rank(df: DataFrame, keys, value: str = "value", out: str = "r", minus_one: bool = True) -> DataFrame:
    """(rank - 1) / (n - 1), or rank / n; null for a key with one row in the first form."""
    n = F.count(F.lit(1)).over(W.partitionBy(*_cols(keys)))
    ranked = average_rank(df, keys, value, "_rk")
    scaled = F.when(n > 1, (F.col("_rk") - 1) / (n - 1)) if minus_one else F.col("_rk") / n
    return ranked.withColumn(out, scaled).drop("_rk")


def ordinal_rank(df: DataFrame, keys, order: list[Column], out: str = "rn") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*_cols(keys)).orderBy(*order)).cast("long"))


def top_n(df: DataFrame, keys, order: list[Column], n: int) -> DataFrame:
    return ordinal_rank(df, keys, order, "_rn").filter(F.col("_rn") <= n).drop("_rn")


def zscore(df: DataFrame, keys, value: str = "value", out: str = "z", eps: float = 0.0) -> DataFrame:
    w = W.partitionBy(*_cols(keys))
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + eps))


def center_on(df: DataFrame, keys, value: str, reference: Column, out: str = "c") -> DataFrame:
    """value minus the mean of the reference rows of its group; groups without reference rows take their own mean."""
    w = W.partitionBy(*_cols(keys))
    return df.withColumn(out, F.col(value) - F.coalesce(F.avg(F.when(reference, F.col(value))).over(w), F.avg(value).over(w)))


def quantile_strata(df: DataFrame, value: str, parts: int, keys=(), out: str = "stratum") -> DataFrame:
    """Stratum by exact quantile edges per group; equal edges merge. No task holds a group's values."""
    keys = _cols(keys)
    edges = exact_quantiles(df, keys, value, [k / parts for k in range(1, parts)]).select(*keys, F.col("q").alias("_e"))
    joined = df.join(edges, keys) if keys else df.join(F.broadcast(edges))  # without keys: one row of edges
    return joined.withColumn(out, F.size(F.filter(F.array_distinct("_e"), lambda e: e < F.col(value))).cast("long")).drop("_e")


def mode_smallest(df: DataFrame, keys, value: str) -> DataFrame:
    """Most frequent value per key, ties to the smallest."""
    keys = _cols(keys)
    seen = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return seen.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"), F.max("_n").alias("n"))


def quantile_normalise(df: DataFrame, sample: str = "sample", feature: str = "feature", value: str = "value") -> DataFrame:
    """Every sample takes the mean of the samples' order statistics at its own ordinal rank."""
    ranked = ordinal_rank(df, sample, [F.col(value), F.col(feature)], "_rn")
    means = ranked.groupBy("_rn").agg(F.avg(value).alias("qn"))
    return ranked.join(means, "_rn").drop("_rn")
