"""Explained results: the scored rows with summary, highlights, evidence, warnings and version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillsight import fixed_values as fv
from tillsight.functions.numeric import clamp
from tillsight.functions.structs import evidence, present, version
from tillsight.functions.text import fmt, percent, plain_number, signed_percent, with_safe_text, won
from tillsight.operators.campaigns import (
    BREAK_EVEN_DECIMALS,
    UPLIFT_DECIMALS,
    break_even_advice,
    break_even_measures,
    retention_actions,
    retention_offers,
    retention_warnings,
    round_columns,
    uplift_measures,
)
from tillsight.operators.menu import menu_pricing, menu_pricing_actions
from tillsight.operators.operations import inventory_advice, inventory_reorder, staffing_advice, staffing_gaps
from tillsight.operators.risk import anomaly_severity
from tillsight.operators.sales import sales_diagnostics
from tillsight.operators.sufficiency import check_window


def with_version(df: DataFrame, agent: str) -> DataFrame:
    """Add the version stamp of an agent; an unknown agent raises."""
    return df.withColumn("version", version(agent))


def with_evidence(df: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """Add `evidence`; rows carry source_name and uploaded_at."""
    return df.withColumn("evidence", F.array(*entries))


def context_lines(*pairs: tuple[str, Column]) -> Column:
    """`name=value` lines."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in pairs])


def with_prompt(df: DataFrame, task: str, context: Column) -> DataFrame:
    """Add `prompt`: the task's template with the row's context filled in."""
    return df.withColumn("prompt", F.replace(F.lit(fv.PROMPTS[task]), F.lit("{context}"), context))


def _window_text() -> Column:
    return F.concat(F.col("window_start").cast("string"), F.lit("~"), F.col("window_end").cast("string"))


def _explained(
    df: DataFrame, kind: str, summary: Column, highlights: Sequence[Column], entries: Sequence[Column]
) -> DataFrame:
    checked = check_window(df).withColumnRenamed("cold_start", "cold_start_mode").drop("day_count")
    return with_safe_text(checked, "summary", summary).withColumns(
        {
            "analysis_type": F.lit(kind),
            "highlights": present(*highlights),
            "evidence": F.array(*entries),
            "version": version("analysis"),
        }
    )


def sales_insight(changes: DataFrame) -> DataFrame:
    """Sales diagnostics with text. Rows carry window_start, window_end, record_count and lineage."""
    rows = sales_diagnostics(changes)
    c = F.col
    direction = F.when(c("direction") == "up", fv.DIRECTION_NAMES["up"]).otherwise(fv.DIRECTION_NAMES["down"])
    lead = c("drivers")[0]
    summary = fmt(
        fv.SALES_SUMMARY, c("revenue_delta_pct"), direction, lead["name"], lead["value"], c("composite_gap")
    )
    top = [fmt(fv.SALES_DRIVER, c("drivers")[i]["name"], c("drivers")[i]["value"]) for i in range(3)]
    advice = F.when(c("direction") == "up", fv.SALES_ADVICE["up"]).otherwise(fv.SALES_ADVICE["down"])
    entries = [
        evidence("revenue_delta", signed_percent(c("revenue_delta_pct")), _window_text()),
        evidence("customer_delta", signed_percent(c("customer_delta_pct")), _window_text()),
        evidence("ticket_delta", signed_percent(c("avg_ticket_delta_pct")), _window_text()),
    ]
    return _explained(rows, "sales_diagnostics", summary, [*top, advice], entries)


def churn_insight(df: DataFrame) -> DataFrame:
    """Add cycle_ratio, risk_band and save_rate to churn input rows."""
    cycle = F.col("cycle_ratio")
    reach = F.when(F.col("risk_band") == "high", 1.1).otherwise(0.95)
    return (
        df.withColumn(
            "cycle_ratio", F.col("delayed_visit_days") / F.nullif(F.col("avg_visit_cycle_days") * 1.0, F.lit(0.0))
        )
        .withColumn("risk_band", F.when(cycle >= 1.6, "high").when(cycle >= 1.2, "medium").otherwise("low"))
        .withColumn("save_rate", clamp(F.col("coupon_redemption_rate") * reach, 0.0, 0.9))
    )


def churn_explanation(df: DataFrame) -> DataFrame:
    """Churn insight with text."""
    rows = churn_insight(df)
    c = F.col
    delay, cycle = c("delayed_visit_days").cast("double"), c("avg_visit_cycle_days").cast("double")
    summary = fmt(fv.CHURN_SUMMARY, c("at_risk_customers"), c("cycle_ratio"), c("risk_band"), c("save_rate") * 100)
    count, wait, coupon = fv.CHURN_HIGHLIGHTS
    highlights = [
        fmt(count, c("at_risk_customers")),
        fmt(wait, delay, cycle),
        fmt(coupon, c("coupon_redemption_rate") * 100),
        F.when(c("risk_band") == "high", F.lit(fv.CHURN_HIGH_ADVICE)),
    ]
    entries = [
        evidence("at_risk", fmt("%,d명", c("at_risk_customers")), _window_text()),
        evidence("visit_delay", fmt("%.1f일", delay), fv.EVIDENCE_PERIODS["recent_visits"]),
        evidence("coupon_rate", percent(c("coupon_redemption_rate")), fv.EVIDENCE_PERIODS["recent_campaign"]),
    ]
    return _explained(rows, "churn_insight", summary, highlights, entries)


def anomaly_explanation(df: DataFrame) -> DataFrame:
    """Severity on the 0-100 scale with text."""
    rows = anomaly_severity(df)
    c = F.col
    impact = c("revenue_impact").cast("double")
    score = c("anomaly_score").cast("double")
    summary = fmt(fv.ANOMALY_SUMMARY, c("anomaly_type"), c("occurrence_count"), score, impact, c("severity"))
    kind, count, loss = fv.ANOMALY_HIGHLIGHTS
    highlights = [
        fmt(kind, c("anomaly_type")),
        fmt(count, c("occurrence_count")),
        fmt(loss, impact),
        F.when(c("severity") == "high", F.lit(fv.ANOMALY_HIGH_ADVICE)),
    ]
    entries = [
        evidence("anomaly_score", fmt("%.1f", score), _window_text()),
        evidence("occurrences", fmt("%d건", c("occurrence_count")), _window_text()),
        evidence("revenue_impact", won(impact), _window_text()),
    ]
    return _explained(rows, "anomaly_explanation", summary, highlights, entries)


def retention_strategy(segments: DataFrame) -> DataFrame:
    """Retention offers with warnings, summary, actions, prompt and evidence."""
    rows = retention_warnings(retention_actions(retention_offers(segments)))
    c = F.col
    summary = fmt(fv.RETENTION_SUMMARY, c("segment_name"), c("customer_count"), c("discount"))
    context = context_lines(
        ("store_id", c("store_id")),
        ("segment_name", c("segment_name")),
        ("customer_count", c("customer_count")),
        ("churn_risk_level", c("churn_risk_level")),
        ("coupon_budget", c("coupon_budget")),
        ("recommended_discount", c("discount")),
    )
    entries = [
        evidence("segment_size", c("customer_count").cast("string"), fv.EVIDENCE_PERIODS["recent_campaign"]),
        evidence("segment_margin", won(c("avg_margin_per_customer").cast("double")), fv.EVIDENCE_PERIODS["last_30_days"]),
    ]
    rows = with_prompt(with_safe_text(rows, "summary", summary), "retention_offer", context)
    return with_version(with_evidence(rows, entries), "strategy")


def break_even_strategy(plans: DataFrame) -> DataFrame:
    """Break-even measures with summary, guide, prompt and evidence."""
    rows = break_even_measures(plans)
    c = F.col
    bep, orders = c("break_even_orders"), c("expected_incremental_orders")
    rate, opened = c("expected_conversion_rate"), c("expected_open_rate")
    summary = fmt(
        fv.BREAK_EVEN_SUMMARY, c("segment_name"), c("target_customers"), c("channel"), rate * 100, bep, orders
    )
    open_text, order_text, chance_text = fv.BREAK_EVEN_GUIDE
    guide = F.array(
        fmt(open_text, c("channel"), opened * 100),
        fmt(order_text, c("menu_name"), bep),
        fmt(chance_text, c("break_even_probability") * 100),
        break_even_advice(c("break_even_probability")),
    )
    context = context_lines(
        ("store_id", c("store_id")),
        ("segment_name", c("segment_name")),
        ("channel", c("channel")),
        ("offer_type", c("offer_type")),
        ("offer_value", plain_number(c("offer_value"))),
        ("target_customers", c("target_customers")),
        ("expected_open_rate", fmt("%.3f", opened)),
        ("expected_conversion_rate", fmt("%.3f", rate)),
        ("break_even_orders", bep),
        ("expected_incremental_orders", orders),
    )
    period = fmt(fv.EVIDENCE_PERIODS["promotion"], c("promo_days"))
    entries = [
        evidence("open_rate", percent(opened), period),
        evidence("conversion_rate", percent(rate), period),
        evidence("break_even_orders", fmt("%,d건", bep), period),
    ]
    rows = with_prompt(
        with_safe_text(rows, "summary", summary).withColumn("action_guide", guide),
        "campaign_bep_simulation",
        context,
    )
    return with_version(round_columns(with_evidence(rows, entries), BREAK_EVEN_DECIMALS), "strategy")


def uplift_strategy(plans: DataFrame) -> DataFrame:
    """Uplift measures with summary, guide, prompt and evidence."""
    rows = uplift_measures(plans)
    c = F.col
    orders, uplift, redeemed = (
        c("expected_incremental_orders"),
        c("expected_uplift_rate"),
        c("expected_redemption_rate"),
    )
    summary = fmt(fv.UPLIFT_SUMMARY, c("segment_name"), c("channel"), uplift * 100, orders)
    redeem_text, order_text, check_text = fv.UPLIFT_GUIDE
    guide = F.array(
        fmt(redeem_text, redeemed * 100),
        fmt(order_text, orders, c("expected_incremental_revenue")),
        F.lit(check_text),
    )
    context = context_lines(
        ("store_id", c("store_id")),
        ("segment_name", c("segment_name")),
        ("channel", c("channel")),
        ("target_customers", c("target_customers")),
        ("discount_rate", fmt("%.2f", c("discount_rate"))),
        ("expected_redemption_rate", fmt("%.3f", redeemed)),
        ("expected_uplift_rate", fmt("%.3f", uplift)),
        ("expected_incremental_orders", orders),
    )
    entries = [
        evidence("uplift", percent(uplift), fv.EVIDENCE_PERIODS["campaign_run"]),
        evidence("redemption", percent(redeemed), fv.EVIDENCE_PERIODS["campaign_run"]),
    ]
    rows = with_prompt(
        with_safe_text(rows, "summary", summary).withColumn("action_guide", guide),
        "campaign_uplift_estimate",
        context,
    )
    return with_version(round_columns(with_evidence(rows, entries), UPLIFT_DECIMALS), "strategy")


def pricing_strategy(menus: DataFrame) -> DataFrame:
    """Menu prices with summary, actions, low-margin warning, prompt and evidence."""
    rows = menu_pricing_actions(menu_pricing(menus))
    c = F.col
    low, high, margin = c("recommended_price_min"), c("recommended_price_max"), c("margin_rate")
    summary = fmt(fv.MENU_SUMMARY, c("menu_id").cast("string"), margin * 100, c("action"), low, high)
    context = context_lines(
        ("store_id", c("store_id")),
        ("menu_id", c("menu_id")),
        ("price", c("price")),
        ("cost", plain_number(c("cost"))),
        ("quantity", plain_number(c("quantity"))),
        ("margin_rate", fmt("%.3f", margin)),
        ("pricing_signal", c("pricing_signal")),
        ("action", c("action")),
        ("recommended_price_range", F.concat_ws("-", low.cast("string"), high.cast("string"))),
    )
    entries = [
        evidence(
            "price_cost",
            fmt("%,d원 / %,.0f원", c("price"), c("cost").cast("double")),
            fv.EVIDENCE_PERIODS["latest_rollup"],
        ),
        evidence(
            "volume_margin",
            fmt("%.0f개 / %.1f%%", c("quantity").cast("double"), margin * 100),
            fv.EVIDENCE_PERIODS["latest_rollup"],
        ),
    ]
    rows = with_prompt(with_safe_text(rows, "summary", summary), "menu_pricing", context)
    return with_version(with_evidence(rows, entries), "strategy")


def staffing_recommendation(df: DataFrame) -> DataFrame:
    """Staffing gaps with advice, prompt and evidence."""
    rows = staffing_advice(staffing_gaps(df))
    c = F.col
    context = context_lines(
        ("store_id", c("store_id")),
        ("hour", c("hour")),
        ("sales", plain_number(c("sales"))),
        ("staff_actual", c("staff_actual")),
        ("staff_recommended", c("staff_recommended")),
        ("gap", c("gap")),
        ("opportunity_cost", c("opportunity_cost")),
    )
    period = F.concat(c("date").cast("string"), F.lit(" "), c("hour").cast("string"), F.lit(":00"))
    entries = [
        evidence("staffing", fmt("%d명 -> %d명", c("staff_actual"), c("staff_recommended")), period),
        evidence("hour_sales", won(c("sales").cast("double")), period),
    ]
    rows = with_prompt(with_safe_text(rows, "recommendation", c("recommendation")), "staffing", context)
    return with_version(with_evidence(rows, entries), "analysis")


def inventory_recommendation(df: DataFrame) -> DataFrame:
    """Inventory reorders with advice, prompt and evidence."""
    rows = inventory_advice(inventory_reorder(df))
    c = F.col
    context = context_lines(
        ("store_id", c("store_id")),
        ("item_id", c("item_id")),
        ("loss_rate", fmt("%.3f", c("loss_rate"))),
        ("system_qty", plain_number(c("system_qty"))),
        ("actual_qty", plain_number(c("actual_qty"))),
        ("reorder_qty", c("reorder_qty")),
        ("estimated_loss_amount", c("estimated_loss_amount")),
    )
    entries = [
        evidence("loss_rate", percent(c("loss_rate")), c("month")),
        evidence(
            "stock_count",
            fmt("%.0f -> %.0f", c("system_qty").cast("double"), c("actual_qty").cast("double")),
            c("month"),
        ),
    ]
    rows = with_prompt(with_safe_text(rows, "recommendation", c("recommendation")), "inventory", context)
    return with_version(with_evidence(rows, entries), "analysis")
