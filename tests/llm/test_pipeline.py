"""The pipeline and the registered queries."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        after = docs.count()
        assert 0 < after <= before, name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.schema.simpleString().count("bigint") == 2, name
        before = after


def test_stages_take_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = docs
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, FOLDER)
    assert 0 < kept.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), FOLDER).count() == 0


def test_the_result_is_that_of_the_stages(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    again = corpus_pipeline.run(spark, FOLDER)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "text", "copies").collect()))
    assert key(got) == key(again) and got.count() > 0


@pytest.mark.parametrize("name", ["op1_warc", "op3_line_dedup", "op8_url_filter", "op9_exact_dedup", "op10_decontamination", "op12_hard_negatives", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        if os.path.exists(f"{FOLDER}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    res = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())


def test_all_are_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert {f"op{i}" for i in range(1, 14)} <= names and "pipeline" in entry.queries()
