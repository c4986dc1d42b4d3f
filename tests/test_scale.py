"""The plans used past the broadcast limit and on hot keys give the same results."""

import pytest
from compare import database, difference
from conftest import DATA, rows
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tillsight.operators.campaigns import target_summary
from tillsight.operators.churn import rfm
from tillsight.operators.risk import event_anomalies

SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
}


@pytest.fixture
def shuffled(spark):
    before = {key: spark.conf.get(key, None) for key in SHUFFLED}
    for key, value in SHUFFLED.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize(
    "name",
    ["event_anomalies", "rfm_segments_by_store", "sales_factors", "menu_quadrants_by_store", "target_summary",
     "valid_targets", "high_value_cancels", "campaign_break_even", "review_sentiment", "action_plan"],
)
def test_without_broadcast(shuffled, name):
    df = contract.queries()[name](shuffled, DATA)
    assert difference(df, database(DATA), contract.oracle_sql()[name]) is None
    assert "BroadcastHashJoin" not in final_plan(df)


def hot_rows(spark, count=60_000):
    """A third of the rows on one key."""
    return spark.range(0, count, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("id") % 997).alias("k"), "id"
    )


def test_hot_group_is_split(shuffled):
    events = hot_rows(shuffled).select(
        F.col("k").cast("string").alias("event_type"), (F.col("id") % 101).cast("double").alias("amount"), "id"
    )
    scored = event_anomalies(events)
    assert "SortMergeJoin(skew=true)" in final_plan(scored)
    found = scored.groupBy("event_type").agg(F.count("*").alias("n")).filter("event_type = '-1'").first()
    assert found["n"] == 20_000
    assert scored.count() == 60_000


def test_hot_customer_and_campaign(spark):
    visits = hot_rows(spark).select(
        F.col("k").alias("customer_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("visit_date"),
        F.lit(0.1).alias("payment_amount"),
    )
    hot = rfm(visits).filter("customer_id = -1").first()
    assert (hot["frequency"], hot["monetary"]) == (20_000, 2000.0)
    # One visit every 291 seconds: no gap reaches a day.
    assert hot["avg_interval"] == 0.0
    targets = hot_rows(spark).select(
        F.lit("one").alias("campaign_id"), F.col("k").alias("customer_id"), F.lit(True).alias("consent"),
        F.when(F.col("id") == 0, 1).otherwise(9).alias("cooldown_days"), F.lit(False).alias("duplicate"),
    )
    assert rows(target_summary(targets)) == [{"campaign_id": "one", "valid_count": 40_000, "excluded_count": 1}]
