"""Campaign rules over tables of segments, plans, targets and campaigns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tillsight import fixed_values as fv
from tillsight.functions.numeric import at_least, at_most, clamp, lookup, nearest_even, ratio, rounded
from tillsight.functions.structs import present, warning
from tillsight.functions.text import fmt

COOLDOWN_DAYS = 7

Limits = tuple[float, float]


@dataclass(frozen=True)
class Certainty:
    """How sure an estimate is: a start, and what recent visits and target customers add, each up to its most."""

    start: float
    visits: tuple[float, float]  # counted up to, divided by
    customers: tuple[float, float]
    limits: Limits

    def of(self, visits: Column, customers: Column) -> Column:
        total = F.lit(self.start)
        for column, (most, part) in ((visits, self.visits), (customers, self.customers)):
            total = total + at_most(column * 1.0, most) / part
        return clamp(total, *self.limits)


@dataclass(frozen=True)
class BreakEvenWeights:
    """Weights of `break_even_measures`; the defaults are the fixed values of the rules."""

    conversion: float = 0.08
    conversion_limits: Limits = (0.03, 0.45)
    most_opened: float = 0.92
    tired_above: float = 2000
    tired: float = 0.94
    most_discount_pull: float = 0.25
    demand: Limits = (0.85, 1.1)  # start, per return rate
    demand_limits: Limits = (0.65, 1.25)
    roi: Limits = (0.92, 2000)  # start, roi rate divided by
    roi_limits: Limits = (0.8, 1.2)
    visits: Limits = (0.9, 4000)  # start, recent visits divided by
    visits_limits: Limits = (0.85, 1.15)
    probability_limits: Limits = (0.01, 0.99)
    certainty: Certainty = Certainty(0.62, (1000.0, 4000), (3000.0, 12000), (0.55, 0.93))
    channels: Mapping[str, float] = field(default_factory=lambda: fv.CHANNEL_OPEN_BIAS)
    segments: Mapping[str, float] = field(default_factory=lambda: fv.SEGMENT_RESPONSE_BIAS)
    other_segments: float = fv.SEGMENT_RESPONSE_DEFAULT
    offers: Mapping[str, float] = field(default_factory=lambda: fv.OFFER_BIAS)


@dataclass(frozen=True)
class UpliftWeights:
    """Weights of `uplift_measures`; the defaults are the fixed values of the rules."""

    discount: Limits = (0.95, 2.4)  # start, per discount rate
    most_discount: float = 1.35
    returning: Limits = (0.85, 1.4)  # start, per return rate
    returning_limits: Limits = (0.75, 1.2)
    redemption_limits: Limits = (0.02, 0.32)
    uplift_limits: Limits = (0.03, 1.5)
    baseline_days: float = 7
    discount_cost: float = 0.6
    least_kept: float = 0.82
    certainty: Certainty = Certainty(0.63, (700.0, 3500), (3000.0, 15000), (0.58, 0.92))
    channels: Mapping[str, float] = field(default_factory=lambda: fv.CHANNEL_REDEMPTION)
    segments: Mapping[str, float] = field(default_factory=lambda: fv.SEGMENT_REDEMPTION)
    other_segments: float = fv.SEGMENT_REDEMPTION_DEFAULT


def retention_offers(
    segments: DataFrame,
    *,
    discounts: Mapping[str, float] = fv.RETENTION_DISCOUNT,
    returns: Mapping[str, float] = fv.RETENTION_RETURN,
    least_discount: int = fv.MIN_RETENTION_DISCOUNT,
) -> DataFrame:
    """Add discount, expected_return and expected_revenue per segment row.

    `discounts` and `returns` go by risk level; an unknown level counts as low. With a budget the discount is limited to
    budget per customer (whole amount, at least `least_discount`).
    """
    risk, count, budget = F.col("churn_risk_level"), F.col("customer_count"), F.col("coupon_budget")
    full = lookup(risk, {level: discounts[level] for level in ("high", "medium")}, discounts["low"]).cast("bigint")
    per_customer = F.expr("cast(coupon_budget as bigint) div nullif(cast(customer_count as bigint), 0)")
    limited = F.least(full, F.greatest(per_customer, F.lit(least_discount).cast("bigint")))
    returning = lookup(risk, {level: returns[level] for level in ("high", "medium")}, returns["low"])
    return (
        segments.withColumn("discount", F.when((budget != 0) & (count > 0), limited).otherwise(full))
        .withColumn("expected_return", returning)
        .withColumn("expected_revenue", F.col("avg_margin_per_customer") * count * F.col("expected_return"))
    )


def retention_actions(offers: DataFrame) -> DataFrame:
    """Add the three actions of a `retention_offers` result."""
    (send, effect, send_priority), wait, remind = fv.RETENTION_ACTIONS

    def action(title: Column, expected: Column, priority: str) -> Column:
        return F.struct(title.alias("title"), expected.alias("expected_effect"), F.lit(priority).alias("priority"))

    return offers.withColumn(
        "actions",
        F.array(
            action(
                fmt(send, F.col("segment_name")),
                fmt(effect, F.col("expected_return") * 100, F.col("expected_revenue")),
                send_priority,
            ),
            *[action(F.lit(title), F.lit(expected), priority) for title, expected, priority in (wait, remind)],
        ),
    )


def retention_warnings(segments: DataFrame, min_customers: int = fv.MIN_SEGMENT_CUSTOMERS) -> DataFrame:
    """Add `warnings`: small_segment and budget_missing."""
    return segments.withColumn(
        "warnings",
        present(
            warning(
                F.col("customer_count") < min_customers, "small_segment", F.lit(fv.SUFFICIENCY_MESSAGES["small_segment"])
            ),
            warning(
                F.col("coupon_budget") == 0, "budget_missing", F.lit(fv.SUFFICIENCY_MESSAGES["budget_missing"])
            ),
        ),
    )


def break_even_measures(plans: DataFrame, weights: BreakEvenWeights = BreakEvenWeights()) -> DataFrame:
    """Add the break-even measures to a table of campaign plans, before rounding.

    An unknown channel or offer type gives nulls; `expect_record(..., "campaign_plan")` rejects both.
    """
    c, w = F.col, weights
    response = lookup(c("segment_name"), w.segments, w.other_segments)
    tired = F.when(c("target_customers") > w.tired_above, w.tired).otherwise(1.0)
    discount_pull = 1.0 + at_most(c("offer_value") / 100, w.most_discount_pull)
    offer_pull = F.when(c("offer_type") == "discount", discount_pull).otherwise(lookup(c("offer_type"), w.offers))
    demand = clamp(w.demand[0] + c("return_rate") * w.demand[1], *w.demand_limits)
    roi = clamp(w.roi[0] + c("roi_rate") / w.roi[1], *w.roi_limits)
    visits = clamp(w.visits[0] + c("recent_visit_count") / w.visits[1], *w.visits_limits)
    discount = F.when(c("offer_type") == "discount", c("menu_price") * (c("offer_value") / 100)).otherwise(
        c("offer_value")
    )
    needed = F.greatest(F.lit(1).cast("bigint"), nearest_even(c("fixed_cost") / F.nullif(c("_unit"), F.lit(0.0))))
    unreachable = F.lit(fv.UNREACHABLE_BREAK_EVEN).cast("bigint")
    orders, profit = c("expected_incremental_orders"), c("expected_incremental_profit")
    open_rate = at_most(lookup(c("channel"), w.channels) * response * tired, w.most_opened)
    conversion = clamp(w.conversion * response * offer_pull * demand * roi * visits, *w.conversion_limits)
    return (
        plans.withColumns(
            {
                "expected_open_rate": open_rate,
                "expected_conversion_rate": conversion,
                "_net": at_least(c("menu_price") - discount, 0.0),
            }
        )
        .withColumns(
            {
                "_unit": at_least(c("_net") * c("margin_rate"), 0.0),
                "_basket": F.greatest(c("avg_order_value"), c("_net")),
                "expected_incremental_orders": nearest_even(c("target_customers") * c("expected_conversion_rate")),
            }
        )
        .withColumns(
            {
                "expected_incremental_revenue": orders * c("_basket"),
                "expected_incremental_profit": orders * c("_unit") - c("fixed_cost"),
                "break_even_orders": F.when(c("_unit") > 0, needed).otherwise(unreachable),
            }
        )
        .withColumns(
            {
                "break_even_revenue": c("break_even_orders") * c("_basket"),
                "break_even_probability": clamp(orders / c("break_even_orders"), *w.probability_limits),
                "expected_roi": ratio(profit, c("fixed_cost"), F.lit(0.0)) * 100,
                "confidence": w.certainty.of(c("recent_visit_count"), c("target_customers")),
                "model_name": F.lit(fv.BREAK_EVEN_MODEL),
            }
        )
        .drop("_net", "_unit", "_basket")
    )


# Decimals of the reported measures.
BREAK_EVEN_DECIMALS = {
    "expected_open_rate": 4,
    "expected_conversion_rate": 4,
    "expected_incremental_revenue": 2,
    "expected_incremental_profit": 2,
    "break_even_revenue": 2,
    "break_even_probability": 4,
    "expected_roi": 2,
    "confidence": 4,
}
UPLIFT_DECIMALS = {"expected_redemption_rate": 4, "expected_uplift_rate": 4, "confidence": 4}


def round_columns(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    return df.withColumns({name: rounded(F.col(name), places) for name, places in decimals.items()})


def campaign_break_even(plans: DataFrame, weights: BreakEvenWeights = BreakEvenWeights()) -> DataFrame:
    """Add the break-even measures, rounded, to a table of campaign plans."""
    return round_columns(break_even_measures(plans, weights), BREAK_EVEN_DECIMALS)


def break_even_advice(probability: Column) -> Column:
    return F.when(probability < 0.8, fv.BREAK_EVEN_ADVICE_LOW).otherwise(fv.BREAK_EVEN_ADVICE_OK)


def uplift_measures(plans: DataFrame, weights: UpliftWeights = UpliftWeights()) -> DataFrame:
    """Add redemption, uplift, orders, revenue and confidence to uplift plans, before rounding of rates."""
    c, w = F.col, weights
    redemption = (
        lookup(c("segment_name"), w.segments, w.other_segments)
        * lookup(c("channel"), w.channels)
        * at_most(w.discount[0] + c("discount_rate") * w.discount[1], w.most_discount)
        * clamp(w.returning[0] + c("return_rate") * w.returning[1], *w.returning_limits)
    )
    baseline = F.greatest(F.lit(1).cast("bigint"), nearest_even(c("recent_visit_count") / w.baseline_days))
    orders = c("expected_incremental_orders")
    kept = at_least(1 - c("discount_rate") * w.discount_cost, w.least_kept)
    return (
        plans.withColumn("expected_redemption_rate", clamp(redemption, *w.redemption_limits))
        .withColumn("expected_incremental_orders", nearest_even(c("target_customers") * c("expected_redemption_rate")))
        .withColumns(
            {
                "expected_uplift_rate": clamp(orders / baseline, *w.uplift_limits),
                "expected_incremental_revenue": rounded(orders * c("avg_order_value") * kept, 2),
                "confidence": w.certainty.of(c("recent_visit_count"), c("target_customers")),
                "model_name": F.lit(fv.UPLIFT_MODEL),
            }
        )
    )


def campaign_uplift(plans: DataFrame, weights: UpliftWeights = UpliftWeights()) -> DataFrame:
    """Add the uplift measures, rounded, to a table of uplift plans."""
    return round_columns(uplift_measures(plans, weights), UPLIFT_DECIMALS)


def exclusion_reason() -> Column:
    """First failing check of a target row, or null."""
    return (
        F.when(~F.col("consent"), "missing_consent")
        .when(F.col("cooldown_days") < COOLDOWN_DAYS, "cooldown_active")
        .when(F.col("duplicate"), "duplicate_target")
    )


def target_exclusions(targets: DataFrame) -> DataFrame:
    """Excluded target rows with their reason."""
    return (
        targets.withColumn("reason", exclusion_reason())
        .filter(F.col("reason").isNotNull())
        .select("campaign_id", "customer_id", "reason")
    )


def valid_targets(targets: DataFrame) -> DataFrame:
    """Target rows whose customer has no excluded row in the campaign."""
    excluded = target_exclusions(targets).select("campaign_id", "customer_id")
    return targets.join(excluded, ["campaign_id", "customer_id"], "left_anti")


def target_summary(targets: DataFrame) -> DataFrame:
    """Per campaign: valid_count and excluded_count.

    Rows fold to one per (campaign, customer) with partial counts, then to one per campaign, so a
    campaign that holds most of the rows is never gathered in one place. A customer excluded by one
    row loses the valid status of all its rows.
    """
    excluded = F.count_if(exclusion_reason().isNotNull())
    per_customer = targets.groupBy("campaign_id", "customer_id").agg(
        F.count("*").alias("_rows"), excluded.alias("_excluded")
    )
    return per_customer.groupBy("campaign_id").agg(
        F.sum(F.when(F.col("_excluded") == 0, F.col("_rows")).otherwise(0)).alias("valid_count"),
        F.sum("_excluded").alias("excluded_count"),
    )


def campaign_handoff(campaigns: DataFrame) -> DataFrame:
    """Add status, retries and message; nothing is sent."""
    status = F.col("status")
    return (
        campaigns.withColumn(
            "status",
            F.when(~F.col("approved"), "pending_approval")
            .when(F.coalesce(F.col("dry_run"), F.lit(True)), "scheduled")
            .otherwise("executed"),
        )
        .withColumn("retries", F.lit(0))
        .withColumn(
            "message",
            F.when(status == "pending_approval", fv.HANDOFF_MESSAGES["pending_approval"])
            .when(status == "scheduled", fmt(fv.HANDOFF_MESSAGES["scheduled"], F.col("channel")))
            .otherwise(fmt(fv.HANDOFF_MESSAGES["executed"], F.col("valid_target_count"))),
        )
    )
