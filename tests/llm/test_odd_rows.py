"""Every operator and stage on nulls, empty and very long texts, bytes that are not UTF-8, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import chat_format, decontaminate, exact_dedup, html_extract, jaccard, language_id, packing, pii, simhash, substring_dedup, toxicity

LONG = "long text of words " * 120_000  # over 2 MB
CLASH = "row part sha raw copies key s token h xh live fp keep_id component_id episode chunk score lang_pred _new _found".split()


@pytest.fixture(scope="module")
def odd(spark):
    """id, text and clashing columns; id 7 holds bytes that are not UTF-8, ids 1 and null are repeated."""
    rows = [(1, "same text here"), (1, "same text here"), (2, "same  text here"), (None, "no id"), (None, "no id"), (3, None), (4, ""), (5, LONG), (6, "tie tie tie"), (8, "tie tie tie"), (9, " \t\n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").union(spark.range(1).select(F.lit(7).cast("long"), F.expr("cast(X'61FF6220FE' as string)")))
    d = d.withColumn("lang", F.lit("en")).withColumn("toxic", F.lit(0))
    return d.select("*", *(F.lit("x").alias(c) for c in CLASH)).repartition(3)


OPERATORS = {
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "pack": lambda d: packing.pack(d, packing.default_tokenizer()).filter("start = 0"),
    "language": lambda d: language_id.identify(d),
    "substring": lambda d: substring_dedup.substring_dedup(d),
    "html": lambda d: html_extract.extract_pages(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"), "key", "row")),
    "toxicity": lambda d: toxicity.toxicity(d, d.select("doc_id", "toxic", "text")),
    "simhash": lambda d: simhash.simhash_components(d),
    "jaccard": lambda d: jaccard.jaccard_components(d),
    "pii": lambda d: pii.pseudonymise(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, odd):
    assert OPERATORS[name](odd).count() == odd.count()
    assert OPERATORS[name](odd.filter("doc_id = 77")).count() == 0


def test_decontamination_on_odd_rows(odd, spark):
    items = spark.createDataFrame([(1, "tie tie tie"), (2, "tie tie tie"), (3, None), (None, "x"), (4, "")], "item_id long, text string")
    items = items.union(spark.range(1).select(F.lit(5).cast("long"), F.expr("cast(X'61FF6220FE' as string)")))
    got = decontaminate.contaminated(odd, items).collect()
    assert {r.doc_id for r in got} <= {6, 8, 7} and decontaminate.contaminated(odd, items.filter("item_id > 90")).count() == 0


def test_chat_on_odd_rows(odd):
    turns = odd.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("text").alias("role"), "text", "chunk", "key")
    assert chat_format.rotate(turns).agg(F.sum("n_turns")).first()[0] == odd.count()
    assert chat_format.rotate(turns.filter("turn = 77")).count() == 0


def test_stages_lose_no_clean_row(odd, spark, sf_dir):
    """Only repeated texts go; the row that is not UTF-8 and those without an id go through every stage."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.filter("doc_id = 77"), sf_dir).count() == 0
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == odd.columns
    assert sorted(str(r.doc_id) for r in docs.select("doc_id").collect()) == ["1", "3", "5", "6", "7", "None"]
