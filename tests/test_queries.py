"""Every registered query against its SQL, and the shape of the plans that matter."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import database, spark_rows, sql_rows
from vacancia.plans import (
    flow_queries,
    page_queries,
    scalar_queries,
    stream_queries,
    table_queries,
)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
MODULES = (scalar_queries, page_queries, table_queries, flow_queries, stream_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def test_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0
    assert "status" in out.columns


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(database(SF), ORACLES[name])


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pages_are_read_by_column(spark):
    text = plan(spark, "parse_pages")
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


@pytest.mark.parametrize("name", ["adapter_health", "first_remote_copy", "latest_signals"])
def test_aggregates_are_partial_first(spark, name):
    assert "partial_" in plan(spark, name)


def test_submissions_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    for name in os.listdir(SF):
        if name != "orders.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    orders = spark.read.parquet(f"{SF}/orders.parquet").repartition(4)
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    folder = tmp_path / "run"
    monkeypatch.setattr(stream_queries.runs, "new_folder", lambda spark, name: str(folder))
    assert stream_queries.submit_stream(spark, str(tmp_path)).count() > 0
    assert len(list((folder / "in").glob("*.parquet"))) > 4
    batches = [p for p in (folder / "checkpoint" / "commits").iterdir() if p.name.isdigit()]
    assert len(batches) == 4
