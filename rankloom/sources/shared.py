"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: Tables that the innermost own_tables() of this thread has seen written.
_owned: ContextVar[list[DataFrame] | None] = ContextVar("owned", default=None)
#: Spark's own setting to remove the exchanges of a query once it has ended.
_REMOVE_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; where it is unset, a temporary one in local mode (tests) and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, whose rows are about known, in one partition a core at most and one more for each 500,000 rows, so that a task's share stays bounded.

    For tables that are written as a step: on a local file system each file that an executor writes starts several processes
    (Hadoop's chmod without native code), each with the executor's memory until it is replaced, so hundreds of files of a
    few rows cost more than their rows. Partitions are read one after the other by fewer tasks; no row is shuffled. Not for
    plans that tell their rows by the task's number.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(cores + rows // 500_000)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, and later readers see one fixed result.

    The exchanges of the write are removed when the table is whole; other queries of the session keep their setting.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_REMOVE_EXCHANGES, "false")
    spark.conf.set(_REMOVE_EXCHANGES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_REMOVE_EXCHANGES, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if (owned := _owned.get()) is not None:
        owned.append(out)
    return out


@contextmanager
def own_tables() -> Iterator[list[DataFrame]]:
    """Tables that materialize() writes inside are deleted at the end, but for those that the caller takes off the list."""
    owned: list[DataFrame] = []
    token = _owned.set(owned)
    try:
        yield owned
    finally:
        _owned.reset(token)
        discard(*owned)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, t._written_at)
    gone = {t._written_at for t in tables}
    _written[:] = [(s, path) for s, path in _written if path not in gone]


def release(spark: SparkSession | None = None) -> None:
    """Delete the tables that materialize() has written; called at exit."""
    keep = []
    for s, path in _written:
        if spark is not None and s is not spark:
            keep.append((s, path))
            continue
        try:
            _delete(s, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass
    _written[:] = keep


atexit.register(release)
