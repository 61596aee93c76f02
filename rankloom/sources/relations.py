"""The long relations that every analysis reads, built from the driver tables.

assay(sample, cohort, label, feature, value): one row per measured value. At scale the exploded form is never
materialised: the explode sits above a column-pruned scan and is fused into the first aggregation's map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy access to the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def assay(self) -> DataFrame:
        each = self.embeddings.select(F.col("vec_id").alias("sample"), (F.col("vec_id") % 4).alias("cohort"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("p", "v"))
        return each.select("sample", "cohort", "label", (F.col("p") + 1).cast("long").alias("feature"), F.col("v").cast("double").alias("value"))

    @property
    def counts(self) -> DataFrame:
        """donor = supplier, kind = brand, feature = size, n = quantity."""
        part = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("kind"), F.col("p_size").cast("long").alias("feature"))
        return self.lineitem.select(F.col("l_suppkey").alias("donor"), "l_partkey", F.col("l_quantity").cast("long").alias("n")).join(part, "l_partkey").drop("l_partkey")

    @property
    def cases(self) -> DataFrame:
        """Orders as scored samples: y = finished or not, cohort = priority, score = total price, covariate = day of the year."""
        return self.orders.filter(F.col("o_orderstatus").isin("F", "O")).select(
            F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("cohort"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
            F.col("o_totalprice").alias("score"), F.dayofyear("o_orderdate").cast("double").alias("covariate"), F.col("o_custkey").alias("cluster"),
        )


#: The same relations for DuckDB.
ASSAY = "assay AS (SELECT vec_id AS sample, vec_id % 4 AS cohort, label::BIGINT AS label, unnest(range(1, len(embedding) + 1)) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"
COUNTS = "counts AS (SELECT l_suppkey AS donor, p_brand AS kind, p_size::BIGINT AS feature, l_quantity::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey)"
CASES = "cases AS (SELECT o_orderkey AS sample, o_orderpriority AS cohort, (o_orderstatus = 'F')::INT AS y, o_totalprice AS score, dayofyear(o_orderdate)::DOUBLE AS covariate, o_custkey AS cluster FROM orders WHERE o_orderstatus IN ('F', 'O'))"
#: Average ranks within sample, and the (r - 1) / (n - 1) scale.
RANKED = "ranked AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY sample) AS nf FROM assay), ranks AS (SELECT sample, cohort, label, feature, (rk - 1) / (nf - 1) AS r FROM ranked)"
