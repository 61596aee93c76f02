"""Degree-preserving rewiring in parallel rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.sources.shared import discard, materialize


def rewire(edges: DataFrame, swap_factor: int = 10, seed: int = 1, most_rounds: int = 200) -> tuple[DataFrame, dict]:
    """(a, b, weight with a < b; {swaps_done, swaps_target, edges, rounds}): edge swaps that keep every node's degree.

    edges: a, b, weight; loops and repeated pairs go first (the largest weight stays). A round deals all edges to buckets
    of about two by a keyed hash and pairs them inside their bucket; a pair (a, b), (c, d) proposes (a, d), (c, b). A
    proposal is dropped when it makes a loop, an edge that there is already, or one that another pair proposes too, so all
    accepted swaps of a round hold at once. Weights go with the first node's edge. Rounds end at swap_factor swaps an edge.
    Edges and proposals meet in one exchange by (a, b) and no table is broadcast, so a round sends the driver only counts.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.filter("a <> b").groupBy(low.alias("a"), high.alias("b")).agg(F.max("weight").alias("weight")).withColumn("swapped", F.lit(False)), "rewire")
    m = now.count()
    target, done, rounds = swap_factor * m, 0, 0
    while m > 1 and done < target and rounds < most_rounds:
        rounds += 1
        draw = F.xxhash64("a", "b", F.lit(seed * 1_000_003 + rounds))
        dealt = now.select("a", "b", "weight", draw.alias("h")).withColumn("bucket", F.pmod(F.col("h"), F.lit(max(1, m // 2))))
        order = W.partitionBy("bucket").orderBy("h", "a", "b", "weight")  # with weight, both uses of the pairs read one exchange
        seated = dealt.withColumn("place", F.row_number().over(order) - 1).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("a", "b", "weight", "h")])
        pairs = seated.filter("place % 2 = 0").withColumnRenamed("place", "pair")

        def turned(a, b, weight, h):
            straight = F.shiftright(h, 40) % 2 == 0
            return {"a": F.when(straight, F.col(a)).otherwise(F.col(b)), "b": F.when(straight, F.col(b)).otherwise(F.col(a)), "weight": F.col(weight)}

        x, y = turned("a", "b", "weight", "h"), turned("next_a", "next_b", "next_weight", "next_h")
        edge = lambda p, q, w: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), w.alias("weight"))
        new = F.array(edge(x["a"], y["b"], x["weight"]), edge(y["a"], x["b"], y["weight"]))
        plain = (x["a"] != y["b"]) & (y["a"] != x["b"]) & (x["a"] != y["a"]) & (x["b"] != y["b"])
        first, second = F.struct("a", "b", "weight"), F.struct(*[F.col(f"next_{c}").alias(c) for c in ("a", "b", "weight")])
        old = F.when(F.col("next_a").isNull(), F.array(first)).otherwise(F.array(first, second))
        asked = pairs.select("bucket", "pair", old.alias("old"), F.when(F.col("next_a").isNotNull() & plain, new).alias("new"))
        wanted = asked.filter("new IS NOT NULL").select("bucket", "pair", F.explode("new").alias("e")).select("bucket", "pair", "e.a", "e.b")
        claims = wanted.unionByName(now.select("a", "b"), allowMissingColumns=True).withColumn("claims", F.count(F.lit(1)).over(W.partitionBy("a", "b")))
        refused = claims.filter("claims > 1 AND bucket IS NOT NULL").groupBy("bucket").agg(F.collect_set("pair").alias("refused"))  # the few pairs of a bucket
        settled = asked.join(refused.hint("merge"), "bucket", "left").withColumn("swapped", F.col("new").isNotNull() & ~F.coalesce(F.array_contains("refused", F.col("pair")), F.lit(False)))
        after = materialize(settled.select("swapped", F.explode(F.when(F.col("swapped"), F.col("new")).otherwise(F.col("old"))).alias("e")).select("e.*", "swapped"), "rewire")
        done += after.filter("swapped").count() // 2
        discard(now)
        now = after
    return now.select("a", "b", "weight"), {"swaps_done": done, "swaps_target": target, "edges": m, "rounds": rounds}
