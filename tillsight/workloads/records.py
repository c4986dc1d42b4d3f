"""Input records of every checked type, read from the star-schema tables: one SELECT per type, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tillsight.operators.expectations import RECORD_RULES

RECORD_INPUTS: dict[str, str] = {
    "analysis": "select o_orderkey % 50 - 1 as record_count from orders",
    "churn_input": """select c_custkey % 40 - 1 as at_risk_customers, c_custkey % 7 - 1 as delayed_visit_days,
        c_custkey % 5 as avg_visit_cycle_days, (c_custkey % 11) * 0.11 as coupon_redemption_rate from customer""",
    "anomaly_input": """select case event_type when 'purchase' then 'payment' when 'click' then 'discount' when 'view' then 'inventory'
        else event_type end as anomaly_type, value as anomaly_score, event_id % 9 as occurrence_count from events""",
    "retention_segment": """select c_custkey % 30 as customer_count, c_acctbal as coupon_budget,
        case c_mktsegment when 'BUILDING' then 'low' when 'MACHINERY' then 'medium' when 'HOUSEHOLD' then 'high'
        when 'FURNITURE' then null else 'none' end as churn_risk_level from customer""",
    "menu": """select p_retailprice - 950 as price, p_retailprice - p_size * 30 as cost, p_size - 2 as quantity,
        1 - p_size * 0.03 as margin_rate from part""",
    "staffing": """select event_id % 26 as hour, value as sales, user_id % 5 as staff_actual,
        event_id % 7 - 1 as staff_recommended from events""",
    "inventory": """select l_quantity as system_qty, l_quantity - l_linenumber * 2 as actual_qty,
        l_discount - 0.02 as loss_rate from lineitem""",
    "campaign_target": """select case when o_orderkey % 13 = 0 then null else o_custkey end as customer_id,
        case o_orderstatus when 'F' then true when 'O' then false end as consent, o_custkey % 20 - 1 as cooldown_days from orders""",
    "campaign_handoff": """select o_custkey % 10 - 1 as valid_target_count,
        case o_orderstatus when 'F' then 'coupon' when 'O' then 'sms' else 'mail' end as channel from orders""",
    "campaign_plan": """select case l_linenumber when 1 then 'sms' when 2 then 'push' when 3 then 'kakao' else 'mail' end as channel,
        case l_returnflag when 'R' then 'discount' when 'A' then 'coupon' else 'free_item' end as offer_type,
        l_extendedprice - 2000 as offer_value, l_suppkey % 5 as target_customers, l_partkey % 70 as promo_days,
        l_tax - 0.01 as fixed_cost, l_extendedprice as menu_price, l_discount * 12 as margin_rate, l_quantity - 3 as daily_avg_qty,
        l_quantity as avg_order_value, l_orderkey % 9 - 1 as recent_visit_count, l_tax * 15 as return_rate from lineitem""",
    "campaign_uplift_plan": """select case o_orderstatus when 'F' then 'push' when 'O' then 'kakao' end as channel,
        o_custkey % 6 as target_customers, (o_orderkey % 13) * 0.09 as discount_rate, o_totalprice - 5000 as avg_order_value,
        o_orderkey % 8 - 2 as recent_visit_count, (o_custkey % 9) * 0.13 as return_rate from orders""",
    "action_plan": """select case o_orderstatus when 'F' then 'retention_recovery' when 'O' then 'operations_tuning'
        else 'anomaly_followup ' end as scenario from orders""",
}


def records(spark: SparkSession, sf_dir: str, record: str) -> DataFrame:
    statement = RECORD_INPUTS[record]
    name = re.search(r"from (\w+)$", statement).group(1)
    return spark.sql(re.sub(r"from \w+$", "from {rows}", statement), rows=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def checks_sql() -> str:
    """Rows, verdicts and broken rules of every record type."""
    parts = []
    for record, rules in RECORD_RULES.items():
        holds = " and ".join(f"coalesce({rule}, false)" for rule in rules.values())
        broken = ", ".join(f"'{name}:' || count(*) filter (not coalesce({rule}, false))" for name, rule in rules.items())
        parts.append(
            f"""select '{record}' as record, count(*) as row_count, count(*) filter ({holds}) as valid_rows,
            count(*) filter (not ({holds})) as rejected_rows, concat_ws('|', {broken}) as broken from ({RECORD_INPUTS[record]})"""
        )
    return "\nunion all ".join(parts)
