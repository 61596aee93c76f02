"""Background of intensity arrays: exponential signal on normal noise, with the mode of a kernel density by counted bins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.quantiles import exact_quantiles

#: Bins of the density, and the factors of the kernel width.
BINS = 1 << 14
WIDTH, IQR_SD, CUT = 0.9, 1.349, 3.0


def density_mode(counts: np.ndarray, low: float, step: float, reach: float) -> float:
    """Centre of the bin at which an Epanechnikov kernel of half-width `reach` sees most counts."""
    half = math.ceil(reach / step)
    kernel = np.maximum(0.0, 1 - (np.arange(-half, half + 1) * step / reach) ** 2)
    return low + step * (int(np.argmax(np.convolve(counts, kernel / kernel.sum(), mode="same"))) + 0.5)


def modes(df: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """keys, mode: per key, from one pass for the spread, one for exact quartiles and one for the counts of `bins` bins."""
    clean = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    spread = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    quartiles = exact_quantiles(clean, keys, "_x", [0.25, 0.75]).select(*keys, (F.col("q")[1] - F.col("q")[0]).alias("_iqr"))
    sd = F.coalesce("_sd", F.lit(0.0))
    scale = F.when(F.col("_iqr") > 0, F.least(sd, F.col("_iqr") / IQR_SD)).otherwise(sd)
    scale = F.when(scale > 0, scale).when(F.col("_min") != 0, F.abs("_min")).otherwise(1.0)
    sized = spread.join(quartiles, keys).withColumn("_bw", WIDTH * scale * F.pow(F.col("_n"), F.lit(-0.2)))
    grid = sized.select(*keys, "_bw", (F.col("_min") - CUT * F.col("_bw")).alias("_low"), ((F.col("_max") - F.col("_min") + 2 * CUT * F.col("_bw")) / bins).alias("_step"))
    at = F.least(F.floor((F.col("_x") - F.col("_low")) / F.col("_step")), F.lit(bins - 1)).cast("int")
    counts = clean.join(grid, keys).groupBy(*keys, "_bw", "_low", "_step", at.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(bins)
        c[g["_bin"]] = g["_c"]
        return g[keys].iloc[:1].assign(mode=density_mode(c, g["_low"].iloc[0], g["_step"].iloc[0], g["_bw"].iloc[0] * 5**0.5))

    return counts.groupBy(*keys).applyInPandas(solve, f"{kinds}, mode double")  # at most `bins` rows a key


def background_parameters(df: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """keys, mu, sigma, alpha of each array."""
    mu = modes(df, keys, value, bins).withColumnRenamed("mode", "mu")
    off = df.select(*keys, F.col(value).cast("double").alias("_v")).join(mu, keys).withColumn("_d", F.col("_v") - F.col("mu"))
    below = off.filter("_d < 0").groupBy(*keys).agg((F.sqrt(F.sum(F.col("_d") * F.col("_d")) / (F.count(F.lit(1)) - 1)) * F.sqrt(F.lit(2.0))).alias("sigma"))
    above = modes(off.filter("_d > 0").select(*keys, "_d"), keys, "_d", bins).select(*keys, (1 / F.col("mode")).alias("alpha"))
    return mu.join(below, keys).join(above, keys)


def expected_signal(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Mean signal given the observed intensity."""
    a = x - mu - alpha * sigma**2
    z = a / sigma
    below = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    ratio = np.where(below > 0, np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / np.where(below > 0, below, 1), -z)
    return a + sigma * ratio


def adjust(df: DataFrame, keys: list[str], value: str, out: str = "adjusted", bins: int = BINS) -> DataFrame:
    """df with the background taken out of value; the parameters are one row a key."""
    joined = df.join(background_parameters(df, keys, value, bins), keys)

    @F.pandas_udf("double")
    def signal(x: pd.Series, mu: pd.Series, sigma: pd.Series, alpha: pd.Series) -> pd.Series:
        return pd.Series(expected_signal(*(v.to_numpy(float) for v in (x, mu, sigma, alpha))))

    return joined.withColumn(out, signal(F.col(value).cast("double"), "mu", "sigma", "alpha")).select(*df.columns, out)
