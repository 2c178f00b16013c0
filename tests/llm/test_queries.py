"""The subpackage's queries that SQL can express, next to their SQL; the others run and keep every row."""

import pytest

from tests.compare import connect, differences
from tests.llm.test_ngram_join import brute
from textguard.llm.queries import entries

QUERIES = entries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_sql(spark, con, sf, name):
    query, sql = QUERIES[name]
    diff, _ = differences(query(spark, sf), con, sql)
    assert diff == ""


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_a_row_for_each_document(spark, sf, name):
    got = [r["doc_id"] for r in QUERIES[name][0](spark, sf).select("doc_id").collect()]
    assert sorted(got) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


def test_ngram_join_next_to_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op8_ngram_join"][0](spark, sf).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 85)
