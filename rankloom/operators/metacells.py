"""Metacells: Lloyd's k-means inside every group of rows, all groups at once, hot groups in pieces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import matrix as M
from rankloom.sources.shared import discard, materialize


def metacells(rows: DataFrame, group: str, row: str, x: str = "x", size: int = 25, most: int = 40, least: int = 20, rounds: int = 10, piece_rows: int = 20_000, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(assignments: group, row, cell, distance; cells: group, cell, n, centre).

    A group of n rows (at least `least`) gets min(max(n // size, 1), most) cells. Seeds are the group's rows of smallest
    keyed hash. A round joins rows with their group's centres on (group, piece): a piece is a hashed share of a group of
    about piece_rows rows, so a group of any size is spread, and the centres that travel are a piece's own copy. Ties go to
    the smaller cell; a cell that loses all rows keeps its centre. Rounds end early when no centre moves.
    """
    base = materialize(rows.select(group, row, x), "metacell-rows")
    sizes = base.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    plan = materialize(sizes.select(group, F.least(F.greatest(F.floor(F.col("n") / size), F.lit(1)), F.lit(most)).cast("int").alias("k"), F.ceil(F.col("n") / piece_rows).cast("int").alias("pieces")), "metacell-plan")
    draw = F.xxhash64(F.col(row), F.lit(seed))
    dealt = materialize(base.join(plan, group).select(group, row, x, F.pmod(F.xxhash64(F.col(row), F.lit(seed + 1)), F.col("pieces")).cast("int").alias("piece")), "metacell-dealt")
    order = F.row_number().over(W.partitionBy(group).orderBy(draw, row))
    seeds = base.join(plan, group).withColumn("cell", (order - 1).cast("int")).filter((F.col("cell") < most) & (F.col("cell") < F.col("k")))
    centres = materialize(seeds.select(group, "cell", F.transform(x, lambda v: v.cast("double")).alias("centre")), "metacell-centres")
    kind, row_kind = (base.schema[c].dataType.simpleString() for c in (group, row))

    def met(centres: DataFrame) -> DataFrame:
        whole = centres.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("cell", "centre"))).alias("c"))  # at most `most` centres
        copies = whole.join(plan, group).select(group, F.transform("c", lambda v: v["centre"]).alias("centres"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        return dealt.join(copies, [group, "piece"]).select(group, row, x, "centres")

    def nearest(b: pd.DataFrame):
        for key, g in b.groupby(group, sort=False):
            c = np.stack([np.asarray(v, float) for v in g["centres"].iloc[0]])
            m = M.stacked(g[x])
            d = (m * m).sum(axis=1)[:, None] - 2 * m @ c.T + (c * c).sum(axis=1)[None, :]
            yield key, g, m, d.argmin(axis=1), np.maximum(d.min(axis=1), 0)

    def sums(batches):
        total: dict = {}
        for b in batches:
            for key, _, m, at, _ in nearest(b):
                for k in np.unique(at):
                    own = m[at == k]
                    total[(key, int(k))] = total.get((key, int(k)), 0) + np.r_[len(own), own.sum(axis=0)]
            if len(total) > 10_000:
                yield pd.DataFrame([(*k, v) for k, v in total.items()], columns=[group, "cell", "v"])
                total = {}
        yield pd.DataFrame([(*k, v) for k, v in total.items()], columns=[group, "cell", "v"])

    for _ in range(rounds):
        new = M.sum_arrays(met(centres).mapInPandas(sums, f"{group} {kind}, cell int, v array<double>"), [group, "cell"])
        mean = F.transform(F.slice("v", 2, 1 << 30), lambda s: s / F.element_at("v", 1))
        moved = centres.join(new, [group, "cell"], "left").select(group, "cell", F.coalesce(mean, "centre").alias("centre"), (F.coalesce(mean, "centre") != F.col("centre")).alias("moved"))
        moved = materialize(moved, "metacell-centres")
        discard(centres)
        centres = moved
        if centres.filter("moved").isEmpty():
            break
    centres = centres.select(group, "cell", "centre")

    def assign(batches):
        for b in batches:
            for key, g, _, at, d in nearest(b):
                yield pd.DataFrame({group: key, row: g[row], "cell": at.astype("int32"), "distance": d})

    placed = materialize(met(centres).mapInPandas(assign, f"{group} {kind}, {row} {row_kind}, cell int, distance double"), "metacell-assigned")
    cells = centres.join(placed.groupBy(group, "cell").agg(F.count(F.lit(1)).alias("n")), [group, "cell"], "left").select(group, "cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "centre")
    return placed, cells
