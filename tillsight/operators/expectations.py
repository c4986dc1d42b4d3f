"""Value constraints of the input records, checked as table expectations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillsight.functions.structs import present

# Constraints per record type, as SQL predicates.
RECORD_RULES: dict[str, dict[str, str]] = {
    "analysis": {"record_count": "record_count >= 0"},
    "churn_input": {
        "at_risk_customers": "at_risk_customers >= 0",
        "delayed_visit_days": "delayed_visit_days >= 0",
        "avg_visit_cycle_days": "avg_visit_cycle_days > 0",
        "coupon_redemption_rate": "coupon_redemption_rate between 0 and 1",
    },
    "anomaly_input": {
        "anomaly_type": "anomaly_type in ('payment', 'discount', 'inventory', 'point_leak')",
        "anomaly_score": "anomaly_score between 0 and 100",
        "occurrence_count": "occurrence_count >= 1",
    },
    "retention_segment": {
        "customer_count": "customer_count >= 1",
        "churn_risk_level": "churn_risk_level in ('low', 'medium', 'high')",
        "coupon_budget": "coupon_budget >= 0",
    },
    "menu": {
        "price": "price >= 0",
        "cost": "cost >= 0",
        "quantity": "quantity >= 0",
        "margin_rate": "margin_rate >= 0",
    },
    "staffing": {
        "hour": "hour between 0 and 23",
        "sales": "sales >= 0",
        "staff_actual": "staff_actual >= 0",
        "staff_recommended": "staff_recommended >= 0",
    },
    "inventory": {
        "system_qty": "system_qty >= 0",
        "actual_qty": "actual_qty >= 0",
        "loss_rate": "loss_rate >= 0",
    },
    "campaign_target": {
        "customer_id": "customer_id is not null",
        "consent": "consent is not null",
        "cooldown_days": "cooldown_days >= 0",
    },
    "campaign_handoff": {
        "valid_target_count": "valid_target_count >= 0",
        "channel": "channel in ('coupon', 'point', 'sms')",
    },
    "campaign_plan": {
        "channel": "channel in ('sms', 'push', 'kakao')",
        "offer_type": "offer_type in ('discount', 'coupon', 'free_item')",
        "offer_value": "offer_value >= 0",
        "target_customers": "target_customers >= 1",
        "promo_days": "promo_days between 1 and 60",
        "fixed_cost": "fixed_cost >= 0",
        "menu_price": "menu_price >= 0",
        "margin_rate": "margin_rate between 0 and 1",
        "daily_avg_qty": "daily_avg_qty >= 0",
        "avg_order_value": "avg_order_value >= 0",
        "recent_visit_count": "recent_visit_count >= 0",
        "return_rate": "return_rate between 0 and 1",
    },
    "campaign_uplift_plan": {
        "channel": "channel in ('sms', 'push', 'kakao')",
        "target_customers": "target_customers >= 1",
        "discount_rate": "discount_rate between 0 and 1",
        "avg_order_value": "avg_order_value >= 0",
        "recent_visit_count": "recent_visit_count >= 0",
        "return_rate": "return_rate between 0 and 1",
    },
    "action_plan": {"scenario": "scenario in ('retention_recovery', 'anomaly_followup', 'operations_tuning')"},
}


def expect(df: DataFrame, rules: Mapping[str, str | Column]) -> DataFrame:
    """Add `violations`: the names of the rules a row breaks, a null value counting as broken."""
    broken = []
    for name, rule in rules.items():
        holds = F.expr(rule) if isinstance(rule, str) else rule
        broken.append(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)))
    return df.withColumn("violations", present(*broken))


def expect_record(df: DataFrame, record: str) -> DataFrame:
    return expect(df, RECORD_RULES[record])


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") == 0).drop("violations")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") > 0)


@dataclass
class SplitRecords:
    """`valid` rows, `rejected` rows with their `violations`, and counts: rows, valid, rejected, and rows that break each rule."""

    valid: DataFrame
    rejected: DataFrame
    counts: dict[str, int]
    broken: dict[str, int]


def split_records(df: DataFrame, rules: str | Mapping[str, str | Column], path: str, *, mode: str = "errorifexists") -> SplitRecords:
    """Check the rows of `df` in one pass: write valid and rejected rows apart under `path` and count them on the way.

    `rules` names a record type or gives the rules. `df` is computed once, whatever is read later; the counts come with the
    write (a task that ran again after a lost executor can count twice there; the tables never hold a row twice).
    """
    rules = RECORD_RULES[rules] if isinstance(rules, str) else rules
    checked = expect(df, rules)
    seen = Observation()
    broken = {f"rule_{i}": F.count_if(F.array_contains("violations", name)) for i, name in enumerate(rules)}
    observed = checked.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.size("violations") > 0).alias("rejected"),
        *(count.alias(alias) for alias, count in broken.items()),
    )
    verdict = F.when(F.size("violations") > 0, "rejected").otherwise("valid")
    observed.withColumn("verdict", verdict).write.mode(mode).partitionBy("verdict").parquet(path)
    found = seen.get
    counts = {"rows": found["rows"], "valid": found["rows"] - found["rejected"], "rejected": found["rejected"]}
    written = df.sparkSession.read.schema(StructType([*checked.schema.fields, StructField("verdict", StringType())])).parquet(path)
    return SplitRecords(
        written.where("verdict = 'valid'").select(*(F.col(f"`{c}`") for c in df.columns)),
        written.where("verdict = 'rejected'").drop("verdict"),
        counts,
        {name: found[f"rule_{i}"] for i, name in enumerate(rules)},
    )
