"""Exact order statistics of few keys with very many values: counted bins, then a second pass inside the bins hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.sources.shared import materialize


def select_ranks(values: DataFrame, keys: list[str], value: str, targets: DataFrame, parts: int = 4096, most: int = 50_000, by_magnitude: bool = False) -> DataFrame:
    """keys, rank, value: the value at each 0-based rank of its key; targets: keys, rank.

    Values are counted in `parts` equal bins of their key's range, a window over the counts finds the bin of each rank,
    and only the values of those bins are looked at again, counted by distinct value. A bin hit that holds more than
    `most` rows of different values is cut into bins once more, by turns in equal steps of the value and of its logarithm
    (by_magnitude), so that neither far outliers nor many orders of magnitude take more than a few rounds. Nulls and NaN
    must be gone.
    """
    lo, hi = F.col("_lo"), F.col("_hi")
    base = values.select(*keys, F.col(value).cast("double").alias("_v"))
    span = base.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    share = (F.col("_v") / 2 - lo / 2) / (hi / 2 - lo / 2)
    if by_magnitude:
        share = F.log1p(share * 1e15) / F.log1p(F.lit(1e15))
    place = F.when(hi > lo, F.least(F.floor(share * parts), F.lit(parts - 1))).otherwise(0).cast("int")
    binned = base.join(span, keys).select(*keys, "_v", place.alias("_bin"))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hits = materialize(targets.join(counts.withColumn("_before", before), keys).filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n"))), "hits")
    done = hits.filter("_least = _most").select(*keys, "rank", F.col("_least").alias(value))
    far = hits.filter("_least < _most")
    large = far.filter(F.col("_n") > most).select(*keys, "_bin").distinct()
    small = far.filter(F.col("_n") <= most)
    inner = binned.join(small.select(*keys, "_bin").distinct(), [*keys, "_bin"]).groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_copies"))
    upto = F.sum("_copies").over(W.partitionBy(*keys, "_bin").orderBy("_v"))
    ranked = inner.withColumn("_upto", upto)
    found = small.join(ranked, [*keys, "_bin"]).filter((F.col("rank") - F.col("_before") < F.col("_upto")) & (F.col("rank") - F.col("_before") >= F.col("_upto") - F.col("_copies")))
    out = done.union(found.select(*keys, "rank", F.col("_v").alias(value)))
    if not large.isEmpty():
        deep = f"_bin_{len(keys)}"
        again = binned.join(large, [*keys, "_bin"]).withColumnRenamed("_bin", deep)
        shifted = far.filter(F.col("_n") > most).select(*keys, F.col("_bin").alias(deep), (F.col("rank") - F.col("_before")).alias("rank"), F.col("_before"))
        inside = select_ranks(again, [*keys, deep], "_v", shifted.drop("_before"), parts, most, not by_magnitude)
        back = shifted.join(inside, [*keys, deep, "rank"]).select(*keys, (F.col("rank") + F.col("_before")).alias("rank"), F.col("_v").alias(value))
        out = out.union(back)
    return out


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], **limits) -> DataFrame:
    """keys, n, q (array): the linearly interpolated quantiles of each key, in the order of probs; nulls and NaN are left out."""
    clean = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    one = clean if keys else clean.withColumn("_all", F.lit(1))
    names = keys or ["_all"]
    sizes = one.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    spots = sizes.select(*names, "n", F.posexplode(F.array(*(F.lit(float(p)) for p in probs))).alias("_k", "_p")).withColumn("_h", (F.col("n") - 1) * F.col("_p"))
    low, up = F.floor("_h").cast("long"), F.ceil("_h").cast("long")
    targets = spots.select(*names, F.explode(F.array(low, up)).alias("rank")).distinct()
    at = materialize(select_ranks(one, names, "_x", targets, **limits), "order-statistics")
    both = spots.withColumns({"_low": low, "_up": up})
    a, b = at.select(*names, F.col("rank").alias("_low"), F.col("_x").alias("_a")), at.select(*names, F.col("rank").alias("_up"), F.col("_x").alias("_b"))
    joined = both.join(a, [*names, "_low"]).join(b, [*names, "_up"])
    q = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_low"))
    out = joined.groupBy(*names, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", q.alias("q")))), lambda x: x["q"]).alias("q"))
    return out.select(*keys, "n", "q")
