"""Running pseudobulk of a count stream: one additive delta a batch, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

KEYS = ["donor", "kind", "feature"]


def merge_batch(path: str):
    """The function for foreachBatch: a batch's sums replace what a former run of the same batch wrote."""

    def run(batch: DataFrame, number: int) -> None:
        batch.groupBy(*KEYS).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")

    return run


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing written yet
        return None


def _published(spark: SparkSession, path: str) -> int | None:
    marks = _read(spark, f"{path}/marks")
    return marks.agg(F.max("upto")).first()[0] if marks is not None else None


def totals(spark: SparkSession, path: str) -> DataFrame | None:
    """donor, kind, feature, n over all batches: the published base, and the deltas after it; None before the first batch."""
    upto, deltas = _published(spark, path), _read(spark, f"{path}/deltas")
    if upto is None:
        return None if deltas is None else deltas.groupBy(*KEYS).agg(F.sum("n").alias("n"))
    base = spark.read.parquet(f"{path}/bases/upto={upto}")
    if deltas is not None:
        base = base.union(deltas.filter(F.col("batch") > upto).select(*base.columns))
    return base.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, path: str) -> int | None:
    """Fold all deltas so far into a new base and publish it by its mark; a run that dies before the mark leaves the old base in force."""
    deltas = _read(spark, f"{path}/deltas")
    upto = deltas.agg(F.max("batch")).first()[0] if deltas is not None else None
    if upto is None or upto == _published(spark, path):
        return upto
    totals(spark, path).write.mode("overwrite").parquet(f"{path}/bases/upto={upto}")
    spark.range(1).select(F.lit(int(upto)).alias("upto")).write.mode("append").parquet(f"{path}/marks")
    return upto


def run(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; counts: donor, kind, feature, n."""
    counts.writeStream.foreachBatch(merge_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
