"""Physical plans: no Python rows, no cross joins, no raw rows gathered in one place; plus the SQL comparison."""

import re

import pytest
from compare import database, difference
from conftest import DATA

import __spark_entry__ as contract
from tillsight.operators.reviews import review_sentiment
from tillsight.workloads import bridges as b
from tillsight.workloads.queries import ORACLES, QUERIES



@pytest.fixture(scope="module")
def connection():
    return database(DATA)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def gathered(plan: str):
    """Each gathering into one partition with the first operator below it that is not a projection."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = next((x for x in lines[i + 1 :] if not re.match(r"[\s:+\-]*(\*\(\d+\) *)?(Project|Filter|ColumnarToRow)\b", x)), "")
            yield line, below


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, DATA)
    plan = physical(df)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search("PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan)
    for above, below in gathered(plan):
        # Of the stored values around a rank there are at most FANOUT.
        assert re.search("Aggregate|TakeOrdered|percentile-values", below), above
    assert name in ORACLES
    assert difference(df, connection, ORACLES[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() >= 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = physical(QUERIES["high_value_cancels"](spark, DATA))
    assert "EqualTo(event_type,error)" in plan or "event_type" in plan
    assert "props" not in plan
    plan = physical(b.hourly_sales(spark, DATA))
    assert "EqualTo(event_type,purchase)" in plan


def test_row_operators_run_on_a_stream(spark, tmp_path):
    source = spark.createDataFrame([("친절",), ("최악",)], "review_text string")
    source.write.parquet(str(tmp_path / "in"))
    stream = review_sentiment(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("streamed").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r["sentiment"] for r in spark.table("streamed").collect()} == {"positive", "negative"}
