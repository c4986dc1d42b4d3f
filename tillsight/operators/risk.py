"""Operational risk: event amounts out of line, cancellation peaks, large cancelled receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillsight.functions.numeric import AMOUNT_SCALE, at_most, band, money_mean, rounded
from tillsight.plans.attach import all_present, attach, grouped
from tillsight.plans.shared import stored

# Severity cuts.
PROBABILITY_CUTS = [(0.7, "high"), (0.4, "medium")]
SCORE_CUTS = [(80, "high"), (50, "medium")]
SERIOUS_SCORE = 2.0
FULL_DEVIATIONS = 3.0


def event_anomalies(
    df: DataFrame,
    group: str = "event_type",
    value: str = "amount",
    *,
    deviations: float = FULL_DEVIATIONS,
    cuts: Sequence[tuple[float, str]] = PROBABILITY_CUTS,
) -> DataFrame:
    """Add anomaly_probability and severity: distance of an amount from its group's mean.

    Three population standard deviations or more give 1; equal amounts give 0; a group of one gives
    0.5. A row without group or amount stays, with null probability and severity.
    """
    statistics = all_present(df, [group, value]).groupBy(group).agg(
        F.count("*").alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")
    )
    distance = F.abs((F.col(value) - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0)))
    probability = (
        F.when(F.col(value).isNull(), F.lit(None).cast("double"))
        .when(F.col("_n") < 2, 0.5)
        .when(F.col("_std") == 0, 0.0)
        .otherwise(rounded(at_most(distance / deviations, 1.0), 4))
    )
    return (
        attach(df, statistics, [group])
        .withColumn("anomaly_probability", probability)
        .withColumn("severity", F.when(F.col("anomaly_probability").isNotNull(), band(F.col("anomaly_probability"), list(cuts), "low")))
        .drop("_n", "_mean", "_std")
    )


def anomaly_severity(
    df: DataFrame, score: str = "anomaly_score", *, cuts: Sequence[tuple[float, str]] = SCORE_CUTS
) -> DataFrame:
    """Add `severity` to scores on the 0-100 scale."""
    return df.withColumn("severity", band(F.col(score), list(cuts), "low"))


def cancel_slots(receipts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per (sales_date, hour): total_count and cancel_count. Counts of parts of the receipts add up to those of all."""
    timed = receipts.select(
        *keys,
        F.col("sales_date").cast("date").alias("sales_date"),
        F.substring_index("sales_time", ":", 1).cast("int").alias("hour"),
        "receipt_no",
        "status",
    )
    slot = [*keys, "sales_date", "hour"]
    return all_present(timed, slot).groupBy(*slot).agg(
        F.count("receipt_no").alias("total_count"),
        F.count_if(F.col("status") == "cancelled").alias("cancel_count"),
    )


def slot_anomalies(slots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add cancel_rate and its z-score over all slots to a table with one row per slot, which is read twice.

    A spread of 0 or a single slot gives score 0.
    """
    slots = slots.withColumn("cancel_rate", F.try_divide("cancel_count", "total_count"))
    statistics = grouped(
        slots, keys, F.avg("cancel_rate").alias("_mean"), F.stddev_samp("cancel_rate").alias("_std")
    )
    score = F.when(
        F.col("_std") > 0, (F.col("cancel_rate") - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
    ).otherwise(0.0)
    return attach(slots, statistics, keys).withColumn("anomaly_score", score).drop("_mean", "_std")


def cancel_anomalies(receipts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per (sales_date, hour): total_count, cancel_count, cancel_rate and its z-score over all slots.

    The slot table is stored: the receipts are scanned once for both the slots and their mean and spread.
    """
    return slot_anomalies(stored(cancel_slots(receipts, keys), "cancel-slots"), keys)


def high_value_cancels(
    receipts: DataFrame, factor: float = 3.0, keys: Sequence[str] = (), *, amount_scale: int | None = AMOUNT_SCALE
) -> DataFrame:
    """Cancelled receipts above `factor` times the mean amount of all receipts."""
    receipts = all_present(receipts, keys)
    mean = grouped(receipts, keys, money_mean(F.col("total_amount"), amount_scale).alias("_mean"))
    cancelled = receipts.filter(F.col("status") == "cancelled")
    return attach(cancelled, mean, keys).filter(F.col("total_amount") > F.col("_mean") * factor).drop("_mean")
