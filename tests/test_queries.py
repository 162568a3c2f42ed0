"""Every registered query against its SQL on the smallest tables."""

import re

import pytest
from compare import connect, duck_rows, spark_rows

import __spark_entry__ as entry
from tracebound.workload import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    columns, rows = spark_rows(df)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    expected_columns, expected = duck_rows(duck, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["subject_id", "errors", "warnings", "valid"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_pruning_and_group_limit(spark, folder):
    plan = plan_of(QUERIES["o01_top_rows"](spark, folder))
    assert "WindowGroupLimit" in plan
    schema = re.findall(r"ReadSchema: (\S+)", plan)[0]
    assert schema == "struct<o_orderkey:bigint,o_orderpriority:string>"


def test_text_readers_do_not_shuffle(spark, folder):
    for name in ("s01_plain_units", "s02_markdown_units", "s03_html_units", "p05_numeric_tokens"):
        assert "Exchange" not in plan_of(QUERIES[name](spark, folder))
