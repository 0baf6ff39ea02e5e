"""The registered queries on the given tables: against their SQL, and the pipeline against its stages."""

import pytest

import corpus_pipeline
from vectrail.llm.queries import QUERIES, SQL

from ..compare import database, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_cover_their_table(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    if name == "op12_lanczos_whitening":
        ids = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id").distinct().count()
        assert found.count() == 32 * ids and found.where("identity_error > 1e-4").count() == 0
    elif name != "op9_decontamination":
        ids = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()}
        assert {r.doc_id for r in found.select("doc_id").collect()} == ids


def test_stages_tell_rows_of_null_or_shared_ids_apart(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[3]), (None, texts[1])]
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("length(text) > 100").first().text
    docs = spark.createDataFrame([*rows, (None, item)], "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF_DIR)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, texts[0]), (0, texts[1]), (5, texts[2]), (5, texts[3]), (0, item)])
    clean = corpus_pipeline.drop_leaks(spark, docs, SF_DIR)
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted((i or 0, t) for i, t in rows)


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), "test-stage")
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.select("doc_id").distinct().count() == before
