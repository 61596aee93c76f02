"""The corpus pipeline on a small table, stage by stage."""

import corpus_pipeline
from rankloom.llm import queries


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after <= before and after
        if name == "exact_dedup":
            texts = [" ".join((r.text or "").split()) for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts)) and len(after) < len(before)
        before = after
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == before


def test_registry():
    q = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in q) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(q)


def test_stages_on_odd_rows(spark, sf_dir):
    """Null ids, repeated rows, null text and an empty table go through every stage; clean rows stay."""
    rows = [(1, "same text here", "a"), (1, "same text here", "b"), (2, "same  text here", "c"), (None, "only with no id", "d"), (3, None, "e"), (4, "", "f"), (5, "another clean text of seven plain words", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.filter("doc_id = 77"), sf_dir).count() == 0
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        ids = [r.doc_id for r in docs.collect()]
        assert None in ids and 5 in ids
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "5", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 4
