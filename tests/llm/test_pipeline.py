"""The pipeline on the smallest scale, and the registered SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import queries as llm
from graphloom.llm.storage import keep

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_do_their_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[1] == counts[2] >= counts[3] >= counts[4]
    used = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 2048 for r in used)
    assert docs.select("doc_id").distinct().count() == counts[4]


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_agrees_with_sql(spark, name):
    from graphloom.plans import catalog
    from tests.compare import compare, connect

    catalog.QUERIES[name], catalog.ORACLES[name] = llm.QUERIES[name], llm.ORACLES[name]
    try:
        ok, note = compare(spark, connect(SF), name, SF)
    finally:
        del catalog.QUERIES[name], catalog.ORACLES[name]
    assert ok, note


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in llm.QUERIES) == list(range(1, 14))
