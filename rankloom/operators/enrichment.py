"""Preranked set enrichment: running sums of sets and of random sets of the same size, normalised, with pooled FDR."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ordering import binned_prefix
from rankloom.sources.shared import materialize

#: Features of one ranked list, which travels to the tasks as one vector.
MOST_FEATURES = 5_000_000


def peaks(positions: np.ndarray, weights: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, index of the member at its peak) of sets given as rows of ascending 0-based positions in a list of `total`.

    The running sum climbs by weight at members and falls evenly between them, so its extremes lie at members: the
    highest just after one, the lowest just before one. No list as long as the ranking is ever summed.
    """
    m = positions.shape[1]
    mass = weights[positions]
    whole = mass.sum(axis=1, keepdims=True)
    mass = np.where(whole > 0, mass / np.where(whole > 0, whole, 1), 1 / m)
    after = np.cumsum(mass, axis=1)
    fall = (positions - np.arange(m)) / max(total - m, 1)
    high, low = after - fall, after - mass - fall
    top, bottom = high.argmax(axis=1), low.argmin(axis=1)
    each = np.arange(len(positions))
    up = high[each, top] >= -low[each, bottom]
    return np.where(up, high[each, top], low[each, bottom]), np.where(up, top, bottom)


def random_sets(rng: np.random.Generator, sets: int, size: int, total: int, block: int = 1 << 21) -> np.ndarray:
    """Ascending positions of `sets` random sets without replacement."""
    step = max(1, block // total)
    parts = [np.sort(np.argpartition(rng.random((min(step, sets - k), total)), size - 1, axis=1)[:, :size], axis=1) for k in range(0, sets, step)]
    return np.vstack(parts)


def preranked(ranked: DataFrame, members: DataFrame, least: int = 5, most: int = 500, reps: int = 1000, seed: int = 1) -> DataFrame:
    """set_id, size, es, nes, p, fdr, tag, leading_edge for sets of least..most members in the ranking.

    ranked: feature, x (one list, largest first, ties by feature); members: set_id, feature. Sets are dealt over tasks, a
    task draws the `reps` random sets of each of its own. p is the share of random scores of the same sign that are as
    far out; fdr compares the shares of random and of observed normalised scores beyond each one, over all sets.
    """
    order = ranked.select("feature", F.col("x").cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").orderBy(F.desc("x"), "feature").limit(MOST_FEATURES + 1).toPandas()
    if len(order) > MOST_FEATURES:
        raise ValueError("the ranking is longer than MOST_FEATURES")
    weights, total = order["x"].abs().to_numpy(), len(order)
    spark = ranked.sparkSession
    kind = ranked.schema["feature"].dataType.simpleString()
    places = spark.createDataFrame(pd.DataFrame({"feature": order["feature"], "position": np.arange(total)}), f"feature {kind}, position long")
    known = members.select("set_id", "feature").distinct().join(places, "feature")
    sets = known.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("position", F.col("feature").cast("string").alias("feature")))).alias("m")).filter(F.size("m").between(least, most))  # at most `most` members
    sets = sets.select("set_id", F.col("m.position").alias("positions"), F.col("m.feature").alias("names"), F.xxhash64("set_id", F.lit(seed)).alias("draw"))
    kinds = sets.schema["set_id"].dataType.simpleString()

    def score(batches):
        for b in batches:
            out = []
            for set_id, positions, names, draw in zip(b["set_id"], b["positions"], b["names"], b["draw"]):
                es, at = (v[0] for v in peaks(np.asarray(positions)[None, :], weights, total))
                null, _ = peaks(random_sets(np.random.default_rng(draw & (1 << 62) - 1), reps, len(positions), total), weights, total)
                same = null >= 0 if es >= 0 else null < 0
                mean = {s: abs(null[(null >= 0) == s].mean()) if ((null >= 0) == s).any() else np.nan for s in (True, False)}
                p = float((np.abs(null[same]) >= abs(es)).mean()) if same.any() else 1.0
                lead = names[: at + 1] if es >= 0 else names[at:]
                scaled = null / np.where(null >= 0, mean[True], mean[False])
                out.append((set_id, len(positions), es, es / mean[bool(es >= 0)], p, len(lead) / len(names), ";".join(lead), np.round(scaled, 9)))
            yield pd.DataFrame(out, columns=["set_id", "size", "es", "nes", "p", "tag", "leading_edge", "null"])

    scored = materialize(sets.mapInPandas(score, f"set_id {kinds}, size long, es double, nes double, p double, tag double, leading_edge string, null array<double>"), "enrichment")
    one = scored.filter("nes IS NOT NULL AND NOT isnan(nes)").select(F.round("nes", 9).alias("v"), F.lit(1.0).alias("seen"), F.lit(0.0).alias("drawn"))
    rest = scored.select(F.explode("null").alias("v"), F.lit(0.0).alias("seen"), F.lit(1.0).alias("drawn"))
    values = one.union(rest).select((F.col("v") >= 0).alias("up"), F.abs("v").alias("far"), "seen", "drawn").groupBy("up", "far").agg(F.sum("seen").alias("seen"), F.sum("drawn").alias("drawn"))
    whole = values.groupBy("up").agg(F.sum("seen").alias("all_seen"), F.sum("drawn").alias("all_drawn"))
    beyond = binned_prefix(values, ["up"], "far", ["seen", "drawn"]).filter("seen > 0").join(whole, "up")
    share = lambda c: (F.col(f"all_{c}") - F.col(f"before_{c}")) / F.col(f"all_{c}")
    rate = beyond.select("up", "far", F.least(F.lit(1.0), share("drawn") / share("seen")).alias("fdr"))
    keyed = scored.drop("null").withColumns({"up": F.col("nes") >= 0, "far": F.abs(F.round("nes", 9))})
    return keyed.join(rate, ["up", "far"], "left").select("set_id", "size", "es", "nes", "p", F.coalesce("fdr", F.lit(1.0)).alias("fdr"), "tag", "leading_edge")
