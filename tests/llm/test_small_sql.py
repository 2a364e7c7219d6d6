"""Every query of the subpackage that has SQL agrees with it on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import oracle_check

from basketlens.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    fault, rows, _, _ = oracle_check.compare(spark, oracle_check.duck(SMALL), SMALL, name, queries.QUERIES[name], queries.ORACLES[name])
    assert not fault
    assert rows


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_answers_for_every_document(spark, name):
    ids = {row.doc_id for row in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}
    assert {row.doc_id for row in queries.QUERIES[name](spark, SMALL).select("doc_id").collect()} == ids
