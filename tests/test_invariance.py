"""Results that must not change with the partitioning of the input, and prompts for every task."""

import random

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from tillsight import fixed_values as fv
from tillsight.operators import campaigns, churn, menu, risk, sales
from tillsight.operators.insights import context_lines, with_prompt
from tillsight.workloads import bridges as b


def settled(df, *order):
    """Rows with doubles cut to 9 digits, in a fixed order."""
    doubles = {f.name: F.round(f.name, 9) for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return rows(df.withColumns(doubles) if doubles else df, *order)


CASES = {
    "segments": (lambda s, p: churn.rfm_segments(churn.rfm(p(b.visits(s, DATA)))), ["customer_id"]),
    "timed": (lambda s, p: churn.rfm(p(b.timed_visits(s, DATA))), ["customer_id"]),
    "quadrants": (
        lambda s, p: menu.menu_quadrants(menu.menu_metrics(p(b.menu_sales(s, DATA)), b.lineup(s, DATA))),
        ["menu_name"],
    ),
    "hours": (lambda s, p: sales.hourly_trend(p(b.hourly_sales(s, DATA)), ["store_id"]), ["store_id", "hour"]),
    "factors": (lambda s, p: sales.sales_factors(p(b.sales_daily(s, DATA))), ["store_id"]),
    "events": (lambda s, p: risk.event_anomalies(p(b.anomaly_events(s, DATA))), ["event_id"]),
    "receipts": (lambda s, p: risk.high_value_cancels(p(b.receipts(s, DATA))), ["receipt_no"]),
    "targets": (lambda s, p: campaigns.target_summary(p(b.campaign_targets(s, DATA))), ["campaign_id"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_partitions_do_not_matter(spark, name):
    run, order = CASES[name]
    one = settled(run(spark, lambda df: df.repartition(1)), *order)
    seven = settled(run(spark, lambda df: df.repartition(7)), *order)
    assert one and one == seven


def test_sums_are_exact(spark):
    random.seed(1)
    cents = [random.randrange(1, 10**7) for _ in range(5000)]
    visits = spark.createDataFrame([("hot", c / 100) for c in cents], "customer_id string, payment_amount double")
    visits = visits.withColumn("visit_date", F.lit("2026-01-01").cast("date")).repartition(6)
    assert churn.rfm(visits).first()["monetary"] == sum(cents) / 100


@pytest.mark.parametrize("task", sorted(fv.PROMPTS))
def test_prompts(spark, task):
    table = spark.createDataFrame([("S001", 3)], "store_id string, hour int")
    context = context_lines(("store_id", F.col("store_id")), ("hour", F.col("hour")))
    found = with_prompt(table, task, context).first()["prompt"]
    assert found == fv.PROMPTS[task].format(context="store_id=S001\nhour=3")
