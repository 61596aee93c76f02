"""Readers on hand-made files, and streams that must equal their batch."""

from pyspark.sql import functions as F

from rankloom.sources import readers
from rankloom.streaming import pseudobulk, windows


def test_series_matrix(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text('!Series_title\t"x"\n!Sample_title\t"one"\t"two"\n!Sample_char\t"sex: F"\t"sex: M"\n!Sample_char\t"age: 3"\t"age: 4"\n!series_matrix_table_begin\n"ID_REF"\t"S1"\t"S2"\n"p1"\t1.5\tNA\n"p2"\t2\t3\n!series_matrix_table_end\n')
    values, notes = readers.series_matrix(spark, str(p))
    assert sorted((r.sample, r.probe, r.value) for r in values.collect()) == [("S1", "p1", 1.5), ("S1", "p2", 2.0), ("S2", "p2", 3.0)]
    assert ("S2", "char", 1, "age: 4") in {(r.sample, r.key, r.item, r.text) for r in notes.collect()}


def test_platform_sets_triplets(spark, tmp_path):
    p = tmp_path / "g.soft"
    p.write_text("^P\n!platform_table_begin\nID\tSYM\n1\tA\n2\tB\n!platform_table_end\n")
    assert sorted((r.ID, r.SYM, r.GENE) for r in readers.platform_table(spark, str(p), ["ID", "SYM", "GENE"]).collect()) == [("1", "A", None), ("2", "B", None)]
    g = tmp_path / "s.gmt"
    g.write_text("setA\tsrc\tG1,1.0\tG2\t\nsetB\tsrc\tG3\n")
    assert sorted((r.set_id, r.feature) for r in readers.gene_sets(spark, str(g)).collect()) == [("setA", "G1"), ("setA", "G2"), ("setB", "G3")]
    m = tmp_path / "m.mtx"
    m.write_text("%%MatrixMarket\n% c\n2 2 2\n1 1 5\n2 1 7\n")
    assert sorted(tuple(r) for r in readers.matrix_market(spark, str(m)).collect()) == [(1, 1, 5.0), (2, 1, 7.0)]


def test_delimited_keeps_na_and_sniffs(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿a;b\nNA;1\n")
    assert readers.sniff_separator(spark, str(p)) == ";"
    assert readers.delimited(spark, str(p), "a string, b int", ";").first().a == "NA"


def test_sheet_with_preamble(spark):
    rows = spark.createDataFrame([(0, ["Title", "x"]), (1, ["Probe ID", "FC"]), (2, ["p1", "2"])], "r int, cells array<string>")
    body, before = readers.sheet_with_preamble(rows, "probe")
    assert {(r.column, r.text) for r in body.collect()} == {("Probe ID", "p1"), ("FC", "2")}
    assert [tuple(r) for r in before.collect()] == [("Title", "x")]


def test_partial_overwrite_and_cache(spark, tmp_path):
    path = str(tmp_path / "t")
    readers.overwrite_parts(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    readers.overwrite_parts(spark.createDataFrame([("b", 3)], "k string, v int"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    d = spark.range(5)
    assert readers.cached(d, str(tmp_path), "x").count() == 5 == readers.cached(d, str(tmp_path), "x").count()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    """Every row is on time within the watermark, so dropping duplicates loses none."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"), batch.schema, 100)
    windows.drain(windows.deduplicated(stream), str(tmp_path / "d"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == batch.select("event_id").distinct().count()
    counts = windows.daily_counts(windows.read_events(spark, str(tmp_path / "in"), batch.schema, 100))
    q = counts.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    key = lambda d: sorted((r.s, r.event_type, r.n) for r in d.select(F.date_format("start", "yyyy-MM-dd").alias("s"), "event_type", "n").collect())
    assert key(spark.table("daily")) == key(windows.daily_counts(batch))
    users = batch.select("user_id").distinct().withColumn("tag", F.lit("u"))
    assert windows.enriched(batch, users).filter("tag IS NULL").count() == 0


def test_files_are_read_by_splits(spark, tmp_path):
    """Small splits: the size line, the header and the order of lines are found whichever task reads them."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        m = tmp_path / "m.mtx"
        m.write_text("%%MatrixMarket\n%\n300 1 300\n" + "".join(f"{k} 1 {k}\n" for k in range(1, 301)))
        assert readers.matrix_market(spark, str(m)).rdd.getNumPartitions() > 2
        assert sorted(r.i for r in readers.matrix_market(spark, str(m)).collect()) == list(range(1, 301))
        p = tmp_path / "a.txt"
        p.write_text("!Sample_title\t1\t2\n!series_matrix_table_begin\nID_REF\tS1\tS2\n" + "".join(f"p{k}\t{k}\t{-k}\n" for k in range(200)) + "!series_matrix_table_end\nafter\t1\t2\n")
        values, notes = readers.series_matrix(spark, str(p))
        assert sorted((r.sample, r.value) for r in values.collect()) == sorted([("S1", float(k)) for k in range(200)] + [("S2", float(-k)) for k in range(200)]) and notes.count() == 2
        t = tmp_path / "t.txt"
        t.write_text("Table 1. Probes\n\n" + "".join(f"{chr(12) if k % 50 == 0 else ''}{k}_at   1.{k}  1e-3  SYM{k}   some title\nfooter {k}\n" for k in range(200)))
        got = readers.printed_table(spark, str(t), r"(\S+_at)\s+([\d.]+)\s+([\d.Ee-]+)\s+(\S+)\s*(.*)", ["probe", "fc", "p", "symbol", "title"]).orderBy("rank").collect()
        assert [(r["rank"], r.probe, r.symbol, r.title) for r in got] == [(k + 1, f"{k}_at", f"SYM{k}", "some title") for k in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_table_is_compressed_by_its_rows(spark, tmp_path):
    for rows, kind in ((5, ".csv"), (50, ".csv.gz")):
        readers.write_table(spark.range(rows).coalesce(1), str(tmp_path / kind), most_plain=20)
        assert [f.name.endswith(kind) for f in (tmp_path / kind).glob("part-*")] == [True]


def test_running_pseudobulk_is_idempotent(spark, tmp_path):
    rows = [(k % 3, f"b{k % 2}", k % 4, k) for k in range(60)]
    schema = "donor long, kind string, feature long, n long"
    all_rows = spark.createDataFrame(rows, schema)
    want = sorted(tuple(r) for r in all_rows.groupBy("donor", "kind", "feature").agg(F.sum("n").alias("n")).collect())
    path, read = str(tmp_path / "sums"), lambda: sorted(tuple(r) for r in pseudobulk.totals(spark, path).collect())
    assert pseudobulk.totals(spark, path) is None and pseudobulk.compact(spark, path) is None
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        pseudobulk.run(stream, path, str(tmp_path / "c"))
        if k == 1:
            assert pseudobulk.compact(spark, path) == 1 == pseudobulk.compact(spark, path)
    assert read() == want
    pseudobulk.merge_batch(path)(spark.createDataFrame(rows[40:], schema), 2)  # the last batch comes again
    pseudobulk.merge_batch(path)(spark.createDataFrame(rows[:20], schema), 0)  # and one that the base already holds
    assert read() == want and pseudobulk.compact(spark, path) == 2 and read() == want


def test_stream_static_join_on_a_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    users = batch.filter("user_id % 2 = 0").select("user_id").distinct().withColumn("tag", F.lit("even"))
    stream = windows.read_events(spark, str(tmp_path / "in"), batch.schema, 1)
    windows.drain(windows.enriched(stream, users).select("event_id", "tag"), str(tmp_path / "out"), str(tmp_path / "c"))
    got, want = spark.read.parquet(str(tmp_path / "out")), windows.enriched(batch, users).select("event_id", "tag")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.filter("tag IS NULL").count() > 0
