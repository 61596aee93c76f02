"""Shared plumbing of the corpus operators: table access, shared-folder tables, batching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.shared import discard, materialize, own_tables, release, shared_dir  # noqa: F401  the operators' way to cut lineage

#: ASCII white space of every word rule here: [\x20\x09-\x0D], which is also what bytes.split() splits on.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns that a text operator reads, the first two under fixed names; other columns never reach Python."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def drop_rows(docs: DataFrame, text_col: str, judge) -> DataFrame:
    """docs without the rows whose text judge() rejects; rows are judged one by one, so doc_id plays no part and nothing is shuffled.

    judge() is called once a task and gives a function from texts (UTF-8, null as empty) to keep flags.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        keep = judge()
        for batch in batches:
            flags: list = []
            for _, texts in small_batches(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["i", "t"])):
                flags += keep(texts)
            yield batch.filter(pa.array(flags, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Bits of a broadcast table of slots, 4 MB whatever the data.
SLOTS = 1 << 25


def slot_table(df: DataFrame, column: str):
    """Broadcast bit table of fixed size: the slots of a column's 64-bit hashes. It only parts rows that are surely not in df from the rest, which a join then judges."""
    spots = df.select(F.col(column).bitwiseAND(F.lit(SLOTS - 1)).alias("at")).filter("at IS NOT NULL").select(F.shiftright("at", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    got = spots.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most SLOTS / 64 rows
    words = np.zeros(SLOTS // 64, np.int64)
    words[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return df.sparkSession.sparkContext.broadcast(words.view(np.uint8))


def taken(slots):
    """A function from 64-bit hashes to flags: is the slot taken?"""
    bits = slots.value

    def judge(keys: np.ndarray) -> np.ndarray:
        at = keys & (SLOTS - 1)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return judge


def in_slots(slots, column: Column) -> Column:
    """Is the slot of a column's 64-bit hash taken? Only that column goes to Python."""

    @F.pandas_udf("boolean")
    def judge(keys: pd.Series) -> pd.Series:
        return pd.Series(taken(slots)(keys.to_numpy()))

    return judge(column)


def small_batches(batch: pa.RecordBatch, max_bytes: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as UTF-8) in runs of at most max_bytes of text, one long text at least; null text counts as empty."""
    ids = batch.column(0).to_pylist()
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > max_bytes:
            yield ids[a:i], [x or b"" for x in texts[a:i]]
            a, size = i, 0
        size += n
    if a < len(ids):
        yield ids[a:], [x or b"" for x in texts[a:]]


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a string column; null is empty and bytes that are not UTF-8 become U+FFFD."""
    return [t.decode("utf-8", "replace") if t else "" for t in column.cast(pa.binary()).to_pylist()]


def rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
