"""Staffing gaps and inventory reorders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillsight import fixed_values as fv
from tillsight.functions.numeric import band, lookup, truncated
from tillsight.functions.text import fmt

# Revenue share lost per missing person, stock shares, amount per lost unit, cuts.
LOST_SALES_SHARE = 0.08
SAFETY_SHARE = 0.1
LOW_RISK_SHARE = 0.05
AMOUNT_PER_UNIT = 1000
LOSS_CUTS = [(0.10, "high"), (0.06, "medium")]


def staffing_gaps(df: DataFrame, *, lost_sales_share: float = LOST_SALES_SHARE, tolerated: int = 0) -> DataFrame:
    """Add gap, status and opportunity_cost to hourly staffing rows; a gap of up to `tolerated` is balanced."""
    gap = F.col("gap")
    cost = truncated((F.col("sales") * lost_sales_share) * gap)
    return (
        df.withColumn("gap", F.col("staff_recommended") - F.col("staff_actual"))
        .withColumn("status", F.when(gap > tolerated, "understaffed").when(gap < -tolerated, "overstaffed").otherwise("balanced"))
        .withColumn("opportunity_cost", F.when(gap <= 0, F.lit(0).cast("bigint")).otherwise(cost))
    )


def staffing_advice(gaps: DataFrame) -> DataFrame:
    """Add the recommendation text to a `staffing_gaps` result."""
    people = F.abs("gap")
    return gaps.withColumn(
        "recommendation",
        F.when(F.col("status") == "understaffed", fmt(fv.STAFFING_ADVICE["understaffed"], people))
        .when(F.col("status") == "overstaffed", fmt(fv.STAFFING_ADVICE["overstaffed"], people))
        .otherwise(fv.STAFFING_ADVICE["balanced"]),
    )


def inventory_reorder(
    df: DataFrame,
    *,
    safety_share: float = SAFETY_SHARE,
    low_risk_share: float = LOW_RISK_SHARE,
    amount_per_unit: float = AMOUNT_PER_UNIT,
    cuts: Sequence[tuple[float, str]] = LOSS_CUTS,
) -> DataFrame:
    """Add risk_level, reorder_qty and estimated_loss_amount to monthly stock counts."""
    system, missing = F.col("system_qty"), F.col("system_qty") - F.col("actual_qty")
    short = F.greatest(truncated(missing), F.lit(0))
    safety = truncated(system * safety_share)
    risk = F.col("risk_level")
    reorder = (
        F.when(missing.isNull(), None)
        .when(risk == "high", short + safety)
        .when(risk == "medium", short + truncated(safety * 0.5))
        .otherwise(F.greatest(short, truncated(system * low_risk_share)))
    )
    return (
        df.withColumn("risk_level", band(F.col("loss_rate"), list(cuts), "low"))
        .withColumn("reorder_qty", reorder)
        .withColumn("estimated_loss_amount", truncated(missing * amount_per_unit))
    )


def inventory_advice(reorders: DataFrame) -> DataFrame:
    """Add the recommendation text to an `inventory_reorder` result."""
    return reorders.withColumn("recommendation", lookup(F.col("risk_level"), fv.INVENTORY_ADVICE))
