"""The pipeline's stages on a small table, and the registered queries."""

from __future__ import annotations

import pytest
from helpers import table

import __spark_entry__ as entry
from lectern.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_apply_decisions(spark, edges, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, edges).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        after = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        if name == "language ID":
            assert after.where("text IS NULL OR NOT text RLIKE '[A-Za-zé]'").count() == 0
        if name == "near-dedup":
            assert after.where("doc_id IN (30, 31, 32, 33)").count() == 1
            assert after.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").count() == 0
        if name == "mixing":
            before, ids = docs.select("doc_id").distinct(), after.select("doc_id").distinct()
            assert ids.exceptAll(before).count() == 0
        if name == "packing":
            assert after.count() == docs.count()
        docs = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert {"pipeline", *names} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5
