"""The numbered queries, and the pipeline stage by stage."""

import corpus_pipeline
import oracle
import pytest

from shiftlens.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert not oracle.differences(QUERIES[name](spark, FOLDER), SQL[name], oracle.connect(FOLDER))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert 0 < docs.count() <= rows
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
            rows = docs.count()
    assert docs.select("doc_id").distinct().count() == before.count()
    clean = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1 AND toxic = 0")
    first = spark.read.parquet(f"{tmp_path}/1")
    lost = spark.read.parquet(f"{FOLDER}/documents.parquet").join(clean, "doc_id", "left_semi").join(first, "doc_id", "left_anti")
    assert lost.count() <= 0.1 * clean.count()
