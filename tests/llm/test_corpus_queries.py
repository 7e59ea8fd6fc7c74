"""The corpus queries against their SQL, and the pipeline stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linewright.llm import near_dedup, packing, quality_model, quality_rules, queries, source_mix
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, queries.QUERIES[name], queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_query_has_a_row_per_row(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    ids = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in queries.QUERIES[name](spark, FOLDER).select(key).collect()} == ids


def test_pipeline_equals_its_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    model = quality_model.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r["doc_id"] for r in quality_model.classify(docs, model).where("predicted = 1").collect()}
    left = docs.where(F.col("doc_id").isin(list(kept & good)))
    groups = near_dedup.groups(left).collect()
    assert len({r["component_id"] for r in groups}) < len(groups)
    left = left.where(F.col("doc_id").isin([r["component_id"] for r in groups]))
    mixed = {r["doc_id"] for r in source_mix.plan(left).where("in_mix").collect()}

    rows = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, FOLDER)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        rows = spark.read.parquet(f"{tmp_path}/{i}")
    assert {r["doc_id"] for r in rows.select("doc_id").collect()} == mixed
    whole = corpus_pipeline.run(spark, FOLDER)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole.select(key).collect()) == sorted(rows.select(key).collect())
    used = whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in used) <= packing.CAPACITY


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(40).selectExpr("*", "'x' AS row", "1 AS kept", "'y' AS score", "0 AS fp", "'z' AS slot", "2 AS id", "3 AS `from`", "4 AS key")
    for table in (docs.limit(0), odd):
        rows = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, FOLDER)
            assert rows.columns == table.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER)
        assert (rows.count() == 0) == (table is not odd)
