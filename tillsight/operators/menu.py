"""Menu engineering (popularity and margin quadrants) and price recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillsight import fixed_values as fv
from tillsight.functions.numeric import exact_mean, lookup, ratio, truncated
from tillsight.functions.structs import present, warning
from tillsight.functions.text import fmt
from tillsight.plans.attach import all_present, attach, grouped
from tillsight.plans.shared import stored

# Quadrant thresholds.
POPULARITY_SHARE = 0.7
PROFITABILITY_CUT = 1.0
LOW_MARGIN = 0.2


@dataclass(frozen=True)
class PricingRule:
    """Margins and quantities at which a price is raised, lowered or bundled."""

    raise_below: float = 0.25  # margin that always raises the price
    popular_raise_below: float = 0.40  # margin that raises it for more than `popular` pieces
    popular: float = 200
    lower_above: float = 0.55  # margin that lowers it for fewer than `slow` pieces
    slow: float = 50
    bundle_below: float = 0.35  # margin that bundles more than `bundled` pieces
    bundled: float = 300
    review_below: float = LOW_MARGIN


def menu_metrics(sales: DataFrame, lineup: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per menu: qty, unit_margin, total_margin, popularity_index and profitability_index.

    Quantities are added up before the join with the price list, whose other columns are kept; a menu
    listed twice there appears twice and counts twice in the totals. The joined table is stored because totals and rows both
    come from it.
    """
    shared = [*keys, "menu_name"]
    quantities = all_present(sales, shared).groupBy(*shared).agg(F.sum("qty").alias("qty"))
    prices = lineup.drop("qty", "unit_margin", "total_margin")
    margin = F.col("sales_price") - F.col("cost_price")
    menus = stored(
        quantities.join(prices, [c for c in shared if c in prices.columns], "inner")
        .withColumn("qty", F.coalesce(F.col("qty"), F.lit(0)))
        .withColumn("unit_margin", margin)
        .withColumn("total_margin", margin * F.col("qty")),
        "menus",
    )
    totals = grouped(
        menus,
        keys,
        F.sum("qty").alias("_total_qty"),
        exact_mean(F.col("unit_margin")).alias("_mean_margin"),
    )
    return (
        attach(menus, totals, keys)
        .withColumn("popularity_index", ratio(F.col("qty") * 1.0, F.col("_total_qty")))
        .withColumn("profitability_index", ratio(F.col("unit_margin"), F.col("_mean_margin")))
        .drop("_total_qty", "_mean_margin")
    )


def menu_quadrants(
    metrics: DataFrame,
    keys: Sequence[str] = (),
    *,
    popularity_share: float = POPULARITY_SHARE,
    profitability_cut: float = PROFITABILITY_CUT,
) -> DataFrame:
    """Add `category`: Star, Plowhorse, Puzzle or Dog.

    Popular means at least `popularity_share` / number of menus of the quantity; profitable means at least
    `profitability_cut` times the mean margin. With a mean margin of 0 the index is undefined and a positive margin counts as profitable.
    """
    counted = attach(metrics, grouped(metrics, keys, F.count("*").alias("_menus")), keys)
    popular = F.coalesce(F.col("popularity_index") >= (1 / F.col("_menus")) * popularity_share, F.lit(False))
    profitable = F.coalesce(
        F.col("profitability_index") >= profitability_cut, F.col("unit_margin") > 0, F.lit(False)
    )
    return counted.withColumn(
        "category",
        F.when(popular & profitable, "Star")
        .when(popular, "Plowhorse")
        .when(profitable, "Puzzle")
        .otherwise("Dog"),
    ).drop("_menus")


def price_move(margin: Column, quantity: Column, rule: PricingRule = PricingRule()) -> Column:
    """Which way the price should go: thin margins raise it, slow sellers with a wide one lower it."""
    thin = (margin < rule.raise_below) | ((margin < rule.popular_raise_below) & (quantity > rule.popular))
    slow = (margin > rule.lower_above) & (quantity < rule.slow)
    return F.when(thin, "raise_price").when(slow, "lower_price").otherwise("hold")


def menu_pricing(df: DataFrame, signal_col: str | None = None, rule: PricingRule = PricingRule()) -> DataFrame:
    """Add pricing_signal, action and the recommended price range.

    `signal_col` names an own signal for the action; the price range always follows the margin rule.
    """
    margin, quantity, price = F.col("margin_rate"), F.col("quantity"), F.col("price")
    signal = F.col(signal_col) if signal_col else F.col("pricing_signal")
    action = (
        F.when(signal == "raise_price", "price_up_test")
        .when(margin < rule.review_below, "cost_review")
        .when((quantity > rule.bundled) & (margin < rule.bundle_below), "bundle_promotion")
        .otherwise("maintain")
    )
    # Price factors (low, high) per signal.
    low = lookup(F.col("pricing_signal"), {"raise_price": 1.05, "lower_price": 0.90}, 1.0)
    high = lookup(F.col("pricing_signal"), {"raise_price": 1.15, "lower_price": 0.98}, 1.05)
    return (
        df.withColumn("pricing_signal", price_move(margin, quantity, rule)).withColumns(
            {
                "action": action,
                "recommended_price_min": truncated(price * low),
                "recommended_price_max": truncated(price * high),
            }
        )
    )


def menu_pricing_actions(priced: DataFrame) -> DataFrame:
    """Add the action list (P0 and P1) and the low-margin warning to a `menu_pricing` result."""

    def step(title: Column, effect: Column, priority: str) -> Column:
        return F.struct(title.alias("title"), effect.alias("expected_effect"), F.lit(priority).alias("priority"))

    follow_up, reason, follow_priority = fv.MENU_FOLLOW_UP
    band = fmt(fv.MENU_ACTION_EFFECT, F.col("recommended_price_min"), F.col("recommended_price_max"))
    return priced.withColumn(
        "actions",
        F.array(
            step(lookup(F.col("action"), fv.MENU_ACTION_TITLES), band, "P0"),
            step(F.lit(follow_up), F.lit(reason), follow_priority),
        ),
    ).withColumn(
        "warnings",
        present(
            warning(
                F.col("margin_rate") < LOW_MARGIN,
                "low_margin_emergency",
                F.lit(fv.SUFFICIENCY_MESSAGES["low_margin_emergency"]),
            )
        ),
    )
