"""Connected components by alternating star joins; written tables in the session's shared folder cut the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.sources.shared import few_files, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over the links (a, b); nodes without links are not listed."""
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")

    def state(x):
        return x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(e)
    for _ in range(most_rounds):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
        small = large.join(low, "a").select(F.explode(F.array(pair("a", "m"), pair("b", "m"))).alias("e"))
        e = materialize(few_files(small.select("e.a", "e.b").filter("a <> b").distinct(), before[0]), "links")
        after = state(e)
        if after == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
    raise RuntimeError("components did not settle")
