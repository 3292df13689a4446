"""Registered llm queries against their SQL on the smallest tables."""

import pytest
from compare import against_sql
from conftest import SMALL

from strata.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    got, want, a, b = against_sql(spark, con, name, QUERIES[name], ORACLES[name], SMALL)
    assert a == b
    assert got == want


def test_queries_without_sql(spark):
    """What must hold of them whatever the data: every document is there once, pieces are within the limit, shares add up."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.count()
    ids = {r["doc_id"]: r["ids"] for r in QUERIES["p8_ids"](spark, SMALL).collect()}
    assert len(ids) == n and all(ids[r["doc_id"]] == [] for r in docs.where("text is null or text = ''").collect())
    long = {k for k, v in ids.items() if len(v) > 2048}
    found = [r["doc_id"] for r in QUERIES["p10_found"](spark, SMALL).collect()]
    assert set(found) == long and len(found) == len(long)
    pieces = QUERIES["p10_pieces"](spark, SMALL).collect()
    assert {r["doc_id"] for r in pieces} == long
    targets = {r["source"]: r for r in spark.read.parquet(f"{SMALL}/mix_targets.parquet").collect()}
    short = {r["source"] for r in QUERIES["p9_found"](spark, SMALL).collect()}
    report = {r["source"]: r for r in QUERIES["p9_report"](spark, SMALL).collect()}
    assert short <= set(targets) and set(report) == set(targets)
    mix = QUERIES["p9_mix"](spark, SMALL).collect()
    assert mix and {r["doc_id"] for r in mix} <= set(ids)
