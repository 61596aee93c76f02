"""Matrices as relations: rows carry a vector column, products are sums over blocks of rows.

A task turns its rows into Arrow blocks, multiplies them, and emits one partial sum for each block pair; partial sums are
added in two levels, so that no task reads one from every other. What comes out has the size of features squared,
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Doubles that assemble() and the fits built on it bring to one place at most: 512 MB.
MOST_DOUBLES = 1 << 26


def sum_arrays(parts: DataFrame, keys: list[str], value: str = "v", fan: int = 64) -> DataFrame:
    """Elementwise sum of array columns per key, in two levels."""
    schema = parts.select(*keys, value).schema

    def add(g: pd.DataFrame) -> pd.DataFrame:
        out = g[keys].iloc[:1].copy()
        out[value] = [np.sum(np.stack(g[value].to_numpy()), axis=0)]
        return out

    some = parts.select(*keys, value, F.pmod(F.spark_partition_id(), F.lit(fan)).alias("_salt")).groupBy(*keys, "_salt").applyInPandas(add, schema)
    return some.groupBy(*keys).applyInPandas(add, schema)


def stacked(column: pd.Series) -> np.ndarray:
    """Rows of an array column as a matrix; a null element is NaN."""
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _chunks(batches, keys: list[str], x: str, rows: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, rows of that key with a leading 1) in blocks of at most about `rows`."""
    held: dict[tuple, list] = {}
    for b in batches:
        for key, g in b.groupby(keys, sort=False):
            m = stacked(g[x])
            held.setdefault(key, []).append(np.hstack([np.ones((len(m), 1)), m]))
            if sum(map(len, held[key])) >= rows:
                yield key, np.vstack(held.pop(key))
    for key, some in held.items():
        yield key, np.vstack(some)


def products(rows: DataFrame, keys: list[str], features: int, x: str = "x", block: int = 256, chunk_rows: int = 4096) -> DataFrame:
    """keys, bi, bj, v: block (bi, bj), bi <= bj, of the sum of (1, x) (1, x)' over each key's rows, row by row.

    Up to `block` features there is one block and the data stay where they are. Beyond, tasks cut their rows into column
    blocks; the blocks of one chunk of rows meet in pairs by a join on the chunk, so a task holds two blocks at a time.
    """
    slim = rows.select(*keys, x)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != x)
    parts_schema = f"{kinds}, bi int, bj int, v array<double>"
    if features < block:

        def whole(batches):
            total: dict = {}
            for key, m in _chunks(batches, keys, x, chunk_rows):
                total[key] = total.get(key, 0) + m.T @ m
            yield pd.DataFrame([(*key, 0, 0, g.ravel()) for key, g in total.items()], columns=[*keys, "bi", "bj", "v"])

        return sum_arrays(slim.mapInPandas(whole, parts_schema), [*keys, "bi", "bj"])

    def cut(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 40
        for key, m in _chunks(batches, keys, x, chunk_rows):
            chunk += 1
            yield pd.DataFrame([(*key, chunk, k, len(m), np.ascontiguousarray(m[:, k * block : (k + 1) * block]).tobytes()) for k in range(-(-m.shape[1] // block))], columns=[*keys, "chunk", "b", "n", "m"])

    from rankloom.sources.shared import materialize

    blocks = materialize(slim.mapInPandas(cut, f"{kinds}, chunk long, b int, n int, m binary"), "blocks")
    left, right = blocks.withColumnsRenamed({"b": "bi", "m": "mi"}), blocks.select(*keys, "chunk", F.col("b").alias("bj"), F.col("m").alias("mj"))
    pairs = left.join(right, [*keys, "chunk"]).filter("bi <= bj")

    def multiply(batches):
        total: dict = {}
        for b in batches:
            for key, n, mi, mj in zip(zip(*(b[k] for k in [*keys, "bi", "bj"])), b["n"], b["mi"], b["mj"]):
                total[key] = total.get(key, 0) + np.frombuffer(mi).reshape(n, -1).T @ np.frombuffer(mj).reshape(n, -1)
                if len(total) >= 64:
                    yield pd.DataFrame([(*k, g.ravel()) for k, g in total.items()], columns=[*keys, "bi", "bj", "v"])
                    total = {}
        yield pd.DataFrame([(*k, g.ravel()) for k, g in total.items()], columns=[*keys, "bi", "bj", "v"])

    return sum_arrays(pairs.mapInPandas(multiply, parts_schema), [*keys, "bi", "bj"])


def entries(blocks: DataFrame, keys: list[str], features: int, block: int = 256) -> DataFrame:
    """keys, i, j, v: the entries i <= j of products(); 0 stands for the column of ones."""
    width = features + 1
    wide = F.least(F.lit(block), F.lit(width) - F.col("bj") * block)
    each = blocks.select(*keys, "bi", "bj", wide.alias("w"), F.posexplode("v").alias("_at", "v"))
    return each.select(*keys, (F.col("bi") * block + F.floor(F.col("_at") / F.col("w"))).cast("long").alias("i"), (F.col("bj") * block + F.col("_at") % F.col("w")).cast("long").alias("j"), "v").filter("i <= j")


def assemble(g: pd.DataFrame, features: int, block: int = 256) -> np.ndarray:
    """The symmetric matrix from one key's blocks."""
    width = features + 1
    if width * width > MOST_DOUBLES:
        raise ValueError(f"{features} features squared are more than one place may hold; work on entries()")
    out = np.zeros((width, width))
    for bi, bj, v in zip(g["bi"], g["bj"], g["v"]):
        rows, cols = min(block, width - bi * block), min(block, width - bj * block)
        m = np.asarray(v).reshape(rows, cols)
        out[bi * block : bi * block + rows, bj * block : bj * block + cols] = m
        out[bj * block : bj * block + cols, bi * block : bi * block + rows] = m.T
    return out


def width_of(rows: DataFrame, x: str = "x") -> int:
    """Length of the vectors; they all have it."""
    first = rows.select(F.size(x).alias("n")).first()
    return first["n"] if first else 0


def oriented(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def tsqr(rows: DataFrame, keys: list[str], x: str = "x", chunk_rows: int = 4096) -> DataFrame:
    """keys, r: the triangular factor of each key's tall matrix, diagonal not negative, by a reduction tree.

    Each task folds its rows into one factor per key; factors are stacked and factored again in two levels. No Gram
    matrix is formed, so small directions keep their digits.
    """
    slim = rows.select(*keys, x)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != x)
    schema = f"{kinds}, r array<double>"

    def fold(batches):
        held: dict = {}
        for key, m in _chunks(batches, keys, x, chunk_rows):
            held[key] = triangle(np.vstack([held[key], m[:, 1:]]) if key in held else m[:, 1:])
        yield pd.DataFrame([(*key, r.ravel()) for key, r in held.items()], columns=[*keys, "r"])

    def stack(g: pd.DataFrame) -> pd.DataFrame:
        size = len(g["r"].iloc[0])
        wide = int(round(size**0.5))
        out = g[keys].iloc[:1].copy()
        out["r"] = [triangle(np.vstack([np.asarray(v).reshape(wide, wide) for v in g["r"]])).ravel()]
        return out

    parts = slim.mapInPandas(fold, schema).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    return parts.groupBy(*keys, "_salt").applyInPandas(stack, schema).groupBy(*keys).applyInPandas(stack, schema)


def triangle(m: np.ndarray) -> np.ndarray:
    """Square R of a matrix (rows of zeros where there are fewer rows than columns), diagonal not negative."""
    r = np.linalg.qr(m, mode="r")
    full = np.zeros((m.shape[1], m.shape[1]))
    full[: len(r)] = r
    return full * np.where(np.diag(full) < 0, -1.0, 1.0)[:, None]


def with_vector(schema: StructType, name: str) -> StructType:
    """The schema with one more array column."""
    return StructType([*schema.fields, StructField(name, ArrayType(DoubleType()))])


def times(rows: DataFrame, right: dict, keys: list[str], x: str = "x", out: str = "q") -> DataFrame:
    """rows with out = x times the small matrix of its key."""
    schema = with_vector(rows.schema, out)

    def run(batches):
        for b in batches:
            y = [None] * len(b)
            for key, at in b.groupby(keys, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                for i, v in zip(at, stacked(b[x].iloc[at]) @ right[key]):
                    y[i] = v
            yield b.assign(**{out: y})

    return rows.mapInPandas(run, schema)


def orthogonal_factor(rows: DataFrame, keys: list[str], x: str = "x") -> tuple[DataFrame, dict]:
    """(rows with q, R by key): x = q R with orthonormal q, for matrices of full column rank.

    q comes from x by the inverse of R, and once more from itself, which brings it to rounding error.
    """

    def factors(df, column):
        return {tuple(r[k] for k in keys): np.asarray(r["r"]).reshape(int(round(len(r["r"]) ** 0.5)), -1) for r in tsqr(df, keys, column).collect()}  # one R a key

    first = factors(rows, x)
    inverse = {k: np.linalg.inv(r) for k, r in first.items()}
    second = factors(times(rows, inverse, keys, x, "_q"), "_q")
    both = {k: inverse[k] @ np.linalg.inv(second[k]) for k in inverse}
    return times(rows, both, keys, x), {k: second[k] @ first[k] for k in first}
