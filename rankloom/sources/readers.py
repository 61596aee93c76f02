"""Readers and sinks of the formats that cohort studies come in, as text scans with explicit schemas.

Formats with sections (series matrices, platform files, coordinate matrices) are read line by line, so a file of any
size is split over tasks; the order of lines inside a file is kept as (start of the split, place in it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, paths) -> DataFrame:
    """(path, n, line); n orders the lines of a file whatever the split that read them."""
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), place.alias("n"), F.col("value").alias("line"))


def _between(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """Lines strictly between the first line equal to begin and the first one equal to end, per file."""
    marks = lines.groupBy("path").agg(F.min(F.when(F.col("line") == begin, F.col("n"))).alias("_b"), F.min(F.when(F.col("line") == end, F.col("n"))).alias("_e"))
    return lines.join(marks, "path").filter((F.col("n") > F.col("_b")) & ((F.col("n") < F.col("_e")) | F.col("_e").isNull())).drop("_b", "_e")


def series_matrix(spark: SparkSession, paths, prefix: str = "!Sample_", begin: str = "!series_matrix_table_begin", end: str = "!series_matrix_table_end") -> tuple[DataFrame, DataFrame]:
    """(values: path, sample, probe, value; annotation: path, sample, key, item, text).

    Annotation rows hold one value per sample; a repeated key keeps its occurrence number in item.
    """
    lines = _lines(spark, paths)
    unquote = lambda c: F.trim(F.regexp_replace(c, '^"|"$', ""))
    table = _between(lines, begin, end).select("path", "n", F.transform(F.split("line", "\t"), unquote).alias("c"))
    first = table.groupBy("path").agg(F.min("n").alias("n"))
    header = table.join(first, ["path", "n"]).select("path", F.col("c").alias("h"))
    body = table.join(first.withColumnRenamed("n", "n0"), "path").filter("n > n0").join(header, "path")
    cells = body.select("path", F.get("c", F.lit(0)).alias("probe"), F.explode(F.arrays_zip(F.slice("h", 2, 1 << 30).alias("s"), F.slice("c", 2, 1 << 30).alias("v"))).alias("x"))
    values = cells.select("path", F.col("x.s").alias("sample"), "probe", F.col("x.v").try_cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    notes = lines.filter(F.col("line").startswith(prefix)).select("path", "n", F.transform(F.split("line", "\t"), unquote).alias("c"))
    keyed = notes.select("path", "n", F.substring(F.get("c", F.lit(0)), len(prefix) + 1, 1000).alias("key"), F.slice("c", 2, 1 << 30).alias("v"))
    from pyspark.sql import Window as W

    item = (F.row_number().over(W.partitionBy("path", "key").orderBy("n")) - 1).cast("long")
    each = keyed.withColumn("item", item).select("path", "key", "item", F.posexplode("v").alias("i", "text"))
    samples = header.select("path", F.posexplode(F.slice("h", 2, 1 << 30)).alias("i", "sample"))
    return values, each.join(samples, ["path", "i"]).select("path", "sample", "key", "item", "text")


def platform_table(spark: SparkSession, paths, columns: list[str], begin: str = "!platform_table_begin", end: str = "!platform_table_end") -> DataFrame:
    """Named columns of a sectioned platform file as strings; a column that a file lacks is null."""
    table = _between(_lines(spark, paths), begin, end).select("path", "n", F.split("line", "\t").alias("c"))
    first = table.groupBy("path").agg(F.min("n").alias("n"))
    header = table.join(first, ["path", "n"]).select("path", F.col("c").alias("h"))
    body = table.join(first.withColumnRenamed("n", "n0"), "path").filter("n > n0").join(header, "path")
    at = lambda c: F.array_position("h", F.lit(c)).cast("int")
    return body.select("path", *(F.when(at(c) > 0, F.get("c", at(c) - 1)).alias(c) for c in columns))


def gene_sets(spark: SparkSession, paths) -> DataFrame:
    """(set_id, source, feature, pos) of ragged set files: name, description, members; a weight after a comma is cut."""
    c = F.split("value", "\t")
    rows = spark.read.text(paths).filter(F.trim("value") != "").select(F.get(c, F.lit(0)).alias("set_id"), F.get(c, F.lit(1)).alias("source"), F.posexplode(F.slice(c, 3, 1 << 30)).alias("pos", "m"))
    return rows.select("set_id", "source", F.trim(F.substring_index("m", ",", 1)).alias("feature"), F.col("pos").cast("long").alias("pos")).filter("feature <> ''")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, x) triplets of a coordinate file, 1-based; comment lines and the size line are skipped."""
    lines = _lines(spark, path).filter(~F.col("line").startswith("%") & (F.trim("line") != ""))
    first = lines.groupBy("path").agg(F.min("n").alias("n0"))
    c = F.split(F.trim("line"), r"\s+")
    return lines.join(first, "path").filter("n > n0").select(F.get(c, F.lit(0)).cast("int").alias("i"), F.get(c, F.lit(1)).cast("int").alias("j"), F.get(c, F.lit(2)).cast("double").alias("x"))


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", null: str | None = None) -> DataFrame:
    """Table with an explicit schema; the literal "NA" survives unless it is named as null."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "PERMISSIVE").option("nullValue", "\x00" if null is None else null)
    return reader.csv(path)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Separator of a table by its first line; a byte-order mark is ignored."""
    line = (spark.read.text(path).first() or [""])[0].lstrip("﻿")
    return max("\t,;|", key=lambda s: (line.count(s), s == "\t"))


def sheet_with_preamble(rows: DataFrame, marker: str) -> tuple[DataFrame, DataFrame]:
    """(table cells: r, column, text; preamble: key, text) of a sheet given as (r, cells array): the header is the first row with the marker."""
    has = F.exists("cells", lambda x: F.lower(F.coalesce(x, F.lit(""))).contains(marker))
    head = rows.filter(has).orderBy("r").limit(1).select(F.col("r").alias("_r"), F.col("cells").alias("_h"))
    body = rows.join(F.broadcast(head), F.col("r") > F.col("_r")).select("r", F.explode(F.arrays_zip(F.col("_h").alias("column"), F.col("cells").alias("text"))).alias("x")).select("r", "x.column", "x.text")
    before = rows.join(F.broadcast(head), F.col("r") < F.col("_r")).select(F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("text"))
    return body.filter("column IS NOT NULL"), before.filter("key IS NOT NULL AND key <> ''")


def with_file_key(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """A column derived from the file's name, for scans of many files."""
    return df.withColumn(name, F.regexp_extract(F.input_file_name(), pattern, 1))


def overwrite_parts(df: DataFrame, path: str, key: str) -> None:
    """Replace only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def printed_table(spark: SparkSession, paths, pattern: str, columns: list[str], page_break: str = "\f") -> DataFrame:
    """path, rank (1-based, in line order) and the pattern's groups as columns, for tables printed as text (a PDF's layout, say).

    A Python UDTF reads a line and gives a row where the whole line matches; page breaks before a line are cut off. Lines
    are read by splits, and ranks are taken over the matching ones alone.
    """
    import re

    from pyspark.sql import Window as W

    @F.udtf(returnType="cells array<string>")
    class Cells:
        def __init__(self):
            self.match = re.compile(pattern).fullmatch

        def eval(self, line: str):
            found = self.match((line or "").lstrip(page_break))
            if found:
                yield ([x.strip() if x is not None else None for x in found.groups()],)

    rows = _lines(spark, paths).lateralJoin(Cells(F.col("line").outer()))
    rank = F.row_number().over(W.partitionBy("path").orderBy("n")).cast("long")
    return rows.select("path", rank.alias("rank"), *(F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(columns)))


def write_table(df: DataFrame, path: str, sep: str = "\t", compress: bool | None = None, most_plain: int = 20_000) -> None:
    """Delimited table with a header; without a choice it is compressed when it has over most_plain rows."""
    if compress is None:
        compress = df.limit(most_plain + 1).count() > most_plain
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def content_key(df: DataFrame) -> str:
    """Order-free content hash of a relation, the validity key of a cached result."""
    h = df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return f"{h[0]}-{h[1]}"


def cached(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written once under its content key and read back; a changed input gives another key."""
    spark, path = df.sparkSession, f"{folder}/{name}-{content_key(df)}"
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001  not there yet
        df.write.mode("ignore").parquet(path)
        return spark.read.parquet(path)
