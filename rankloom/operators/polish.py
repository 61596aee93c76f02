"""Median polish of tables with very many rows and few columns, without holding a table in one place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import matrix as M
from rankloom.operators.quantiles import exact_quantiles


def polished_levels(rows: DataFrame, key: str, row: str, x: str = "x", most_sweeps: int = 10, still: float = 1e-6) -> DataFrame:
    """key, row, level: overall level plus row effect of every row of its key's table (a vector x a row).

    The medians of a row are its own vector's. The medians of a column run over all rows of the key and come by exact
    quantiles of few keys; they are few (keys times columns), so they go along in the closure, and each sweep starts from
    the rows as they are and takes the earlier medians out again. Sweeps end when no column moves by `still`.
    """
    taken: list[dict] = []  # of each sweep: key -> medians of its columns

    def swept(b: pd.DataFrame):
        left = M.stacked(b[x])
        level = np.zeros(len(left))
        for columns in [*taken, None]:  # the rows once more than the columns
            middle = np.nanmedian(left, axis=1)
            level += middle
            left = left - middle[:, None]
            if columns is not None:
                left = left - np.stack([columns[k] for k in b[key]])
        return level, left

    def residuals(batches):
        for b in batches:
            yield b[[key]].assign(left=list(swept(b)[1]))

    kind, row_kind = (rows.schema[c].dataType.simpleString() for c in (key, row))
    for _ in range(most_sweeps):
        long = rows.select(key, x).mapInPandas(residuals, f"{key} {kind}, left array<double>").select(key, F.posexplode("left").alias("_column", "_left"))
        found: dict = {}
        for r in exact_quantiles(long, [key, "_column"], "_left", [0.5]).collect():  # keys times columns
            found.setdefault(r[key], {})[r["_column"]] = r["q"][0]
        taken.append({k: np.array([v.get(i, 0.0) for i in range(max(v) + 1)]) for k, v in found.items()})
        if max((np.abs(v).max() for v in taken[-1].values()), default=0.0) <= still:
            break
    overall = {k: float(np.median(sum(t[k] for t in taken))) for k in taken[0]}

    def levels(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], row: b[row], "level": swept(b)[0] + b[key].map(overall)})

    return rows.select(key, row, x).mapInPandas(levels, f"{key} {kind}, {row} {row_kind}, level double")
