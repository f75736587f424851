"""Registered queries: same rows as their SQL, and plans that hold at scale."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from feedloom.plans import workload
from tools.check_oracle import cell

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for file in pathlib.Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(workload.ORACLE))
def test_same_rows_as_sql(spark, con, name):
    df = workload.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.execute(workload.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(cell(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)


def test_every_query_is_checked():
    assert set(workload.QUERIES) == set(workload.ORACLE)


def test_entry_registers_the_workload():
    assert set(workload.QUERIES) <= set(entry.queries()) and set(workload.ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["user_id", "n"]


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_plans(spark, name):
    """No cross products and no Python."""
    plan = workload.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_feed_is_parsed_once_per_line(spark):
    plan = entry.queries()["criteria_or"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # The props column of the vehicle is one parse, the feed line the other.
    assert plan.count("parseJson") == 2


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["latest_per_key"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]
