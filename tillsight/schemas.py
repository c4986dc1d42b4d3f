"""Column contracts of the seven store datasets and of the metric log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LINEAGE = (("source_name", "string"), ("uploaded_at", "timestamp"))


@dataclass(frozen=True)
class Dataset:
    """Columns as (name, type); `whole_price` is a number text truncated to a whole amount."""

    columns: tuple[tuple[str, str], ...]
    key_fields: tuple[str, ...]

    @property
    def all_columns(self) -> tuple[tuple[str, str], ...]:
        return self.columns + LINEAGE

    @property
    def numeric(self) -> tuple[str, ...]:
        return tuple(name for name, kind in self.columns if kind in ("double", "int", "whole_price"))


# Column names, types and the fields whose blanks a profile counts.
DATASETS = {
    "sales": Dataset(
        (
            ("date", "date"),
            ("store_id", "string"),
            ("revenue", "double"),
            ("orders", "double"),
            ("customers", "double"),
            ("avg_ticket", "double"),
            ("channel", "string"),
            ("weather", "string"),
            ("promo_flag", "int"),
        ),
        ("date", "store_id", "revenue", "customers", "avg_ticket"),
    ),
    "customer": Dataset(
        (
            ("customer_id", "string"),
            ("store_id", "string"),
            ("recency", "double"),
            ("frequency", "double"),
            ("monetary", "double"),
            ("last_visit_days", "double"),
            ("coupon_use_rate", "double"),
            ("churned", "int"),
        ),
        ("customer_id", "store_id", "recency", "frequency", "monetary"),
    ),
    "review": Dataset(
        (
            ("review_id", "string"),
            ("store_id", "string"),
            ("rating", "int"),
            ("review_text", "string"),
            ("sentiment_label", "string"),
        ),
        ("review_id", "store_id", "rating", "review_text"),
    ),
    "anomaly": Dataset(
        (
            ("event_id", "string"),
            ("store_id", "string"),
            ("event_type", "string"),
            ("amount", "double"),
            ("employee_id", "string"),
            ("event_time", "timestamp"),
            ("is_anomaly", "int"),
        ),
        ("event_id", "store_id", "event_type", "amount"),
    ),
    "menu": Dataset(
        (
            ("menu_id", "string"),
            ("store_id", "string"),
            ("price", "whole_price"),
            ("cost", "double"),
            ("quantity", "double"),
            ("margin_rate", "double"),
            ("category", "string"),
        ),
        ("menu_id", "store_id", "price", "cost", "margin_rate"),
    ),
    "inventory": Dataset(
        (
            ("month", "string"),
            ("store_id", "string"),
            ("item_id", "string"),
            ("system_qty", "double"),
            ("actual_qty", "double"),
            ("loss_rate", "double"),
        ),
        ("month", "store_id", "item_id", "system_qty", "actual_qty"),
    ),
    "staffing": Dataset(
        (
            ("date", "date"),
            ("store_id", "string"),
            ("hour", "int"),
            ("sales", "double"),
            ("staff_actual", "int"),
            ("staff_recommended", "int"),
        ),
        ("date", "store_id", "hour", "sales", "staff_actual", "staff_recommended"),
    ),
}

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("sample_size", T.LongType()),
        T.StructField("created_at", T.StringType()),
    ]
)


_SOURCE = "source_name string, uploaded_at timestamp"
_WINDOW = f"store_id string, window_start date, window_end date, record_count bigint, {_SOURCE}"

# Schemas of the record feeds, read as JSON lines or parquet.
FEEDS = {
    "sales_lines": "store_key string, store_name string, sales_date date, hour int, menu_name string, "
    "qty int, revenue double, sales_price double, cost_price double",
    "lineup": "menu_name string, sales_price double, cost_price double",
    "visits": "customer_id string, store_key string, visit_date timestamp, payment_amount double",
    "receipts": "receipt_no string, store_key string, sales_date date, sales_time string, "
    "total_amount double, status string",
    "sales_delta": f"{_WINDOW}, revenue_delta_pct double, customer_delta_pct double, avg_ticket_delta_pct double, "
    "channel_delta_pct double, weather_impact_pct double",
    "churn_input": f"{_WINDOW}, at_risk_customers bigint, delayed_visit_days double, avg_visit_cycle_days double, "
    "coupon_redemption_rate double",
    "anomaly_input": f"{_WINDOW}, anomaly_type string, anomaly_score double, occurrence_count bigint, "
    "revenue_impact double",
    "retention_segment": "store_id string, segment_name string, customer_count bigint, "
    f"avg_margin_per_customer double, churn_risk_level string, coupon_budget bigint, {_SOURCE}",
    "menu": "store_id string, menu_id string, price int, cost double, quantity double, margin_rate double, "
    f"category string, {_SOURCE}",
    "staffing": "store_id string, date date, hour int, sales double, staff_actual int, staff_recommended int, "
    f"{_SOURCE}",
    "inventory": "store_id string, month string, item_id string, system_qty double, actual_qty double, "
    f"loss_rate double, {_SOURCE}",
    "campaign_target": "campaign_id string, customer_id string, consent boolean, cooldown_days int, duplicate boolean",
    "campaign_handoff": "campaign_id string, approved boolean, valid_target_count bigint, channel string, "
    "dry_run boolean",
    "campaign_plan": "store_id string, segment_name string, channel string, offer_type string, offer_value double, "
    "target_customers bigint, promo_days int, fixed_cost double, menu_name string, menu_price double, "
    "margin_rate double, daily_avg_qty double, avg_order_value double, recent_visit_count bigint, "
    f"return_rate double, roi_rate double, {_SOURCE}",
    "campaign_uplift_plan": "store_id string, segment_name string, channel string, target_customers bigint, "
    "discount_rate double, avg_order_value double, recent_visit_count bigint, return_rate double, "
    f"roi_rate double, {_SOURCE}",
    "store": "store_id string, roi_rate double, avg_order_value double, recent_visit_count bigint",
    "action_plan": "store_id string, scenario string, dry_run boolean",
}


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise KeyError(f"Unknown dataset: {name}")
    return DATASETS[name]
