"""Sales: change drivers per store, diagnostics of given changes, hourly trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillsight import fixed_values as fv
from tillsight.functions.numeric import AMOUNT_SCALE, money_mean, money_sum, ratio, rounded
from tillsight.functions.structs import ranked
from tillsight.functions.text import fmt
from tillsight.plans.attach import all_present

# Weights of the change drivers.
CUSTOMER_WEIGHT = 0.45
TICKET_WEIGHT = 0.35
CHANNEL_WEIGHT = 0.15
WEATHER_WEIGHT = 0.05
PROMO_POINTS = 5.0
PEAK_SHARE = 0.8


def sales_changes(
    daily: DataFrame, keys: Sequence[str] = ("store_id",), order: Sequence[str] = ("date", "channel")
) -> DataFrame:
    """Per store: first-to-last change in percent of revenue, customers, avg_ticket and orders.

    First and last row follow `order`; a change from 0 counts as 0. Also gives the first and last
    date, the row count and the share of promotion rows.
    """
    measures = ("revenue", "customers", "avg_ticket", "orders")
    row = F.struct(*order, *measures)
    # Only the two edge rows of a store travel in the shuffle, whatever its number of rows.
    edges = all_present(daily, keys).groupBy(*keys).agg(
        F.min(row).alias("first"),
        F.max(row).alias("last"),
        F.count("*").alias("record_count"),
        (F.sum("promo_flag").cast("double") / F.count("*")).alias("promo_share"),
    )

    def change(name: str) -> Column:
        start, end = F.col(f"first.{name}"), F.col(f"last.{name}")
        return ratio((end - start) * 1.0, start, F.lit(0.0)) * 100

    return edges.select(
        *keys,
        F.col(f"first.{order[0]}").alias("window_start"),
        F.col(f"last.{order[0]}").alias("window_end"),
        "record_count",
        "promo_share",
        change("revenue").alias("revenue_delta_pct"),
        change("customers").alias("customer_delta_pct"),
        change("avg_ticket").alias("avg_ticket_delta_pct"),
        change("orders").alias("channel_delta_pct"),
    )


def sales_factors(
    daily: DataFrame,
    keys: Sequence[str] = ("store_id",),
    order: Sequence[str] = ("date", "channel"),
    *,
    customer_weight: float = CUSTOMER_WEIGHT,
    ticket_weight: float = TICKET_WEIGHT,
    channel_weight: float = CHANNEL_WEIGHT,
    promo_points: float = PROMO_POINTS,
) -> DataFrame:
    """Per store: dominant_factor, the three top_factors and revenue_delta_pct (2 decimals)."""
    changes = sales_changes(daily, keys, order)
    by_impact = ranked(
        [
            ("customers", F.abs("customer_delta_pct") * customer_weight),
            ("avg_ticket", F.abs("avg_ticket_delta_pct") * ticket_weight),
            ("channel_mix", F.abs("channel_delta_pct") * channel_weight),
            ("promo", F.col("promo_share") * promo_points),
        ]
    )
    enough = F.col("record_count") >= 2
    too_short = F.array(F.lit("revenue"), F.lit("orders"), F.lit("customers"))
    top = F.when(enough, F.slice(by_impact, 1, 3).getField("name")).otherwise(too_short)
    return changes.select(*keys, top.alias("top_factors"), "record_count", "revenue_delta_pct").select(
        *keys,
        F.col("top_factors")[0].alias("dominant_factor"),
        "top_factors",
        F.when(F.col("record_count") >= 2, rounded(F.col("revenue_delta_pct"), 2)).otherwise(0.0).alias("revenue_delta_pct"),
    )


def sales_diagnostics(changes: DataFrame) -> DataFrame:
    """Add weighted impacts, their sum, the direction and the drivers by size of raw change.

    Input columns: revenue_delta_pct, customer_delta_pct, avg_ticket_delta_pct, channel_delta_pct
    and weather_impact_pct (0 when absent).
    """
    if "weather_impact_pct" not in changes.columns:
        changes = changes.withColumn("weather_impact_pct", F.lit(0.0))
    inputs = ("customer_delta_pct", "avg_ticket_delta_pct", "channel_delta_pct", "weather_impact_pct")
    drivers = ranked([(name, F.abs(column)) for name, column in zip(fv.DRIVER_NAMES, inputs)])
    values = F.create_map(*[c for pair in zip(map(F.lit, fv.DRIVER_NAMES), map(F.col, inputs)) for c in pair])
    impacts = {
        "traffic_impact": F.col("customer_delta_pct") * CUSTOMER_WEIGHT,
        "ticket_impact": F.col("avg_ticket_delta_pct") * TICKET_WEIGHT,
        "channel_impact": F.col("channel_delta_pct") * CHANNEL_WEIGHT,
        "weather_impact": F.col("weather_impact_pct") * WEATHER_WEIGHT,
    }
    traffic, ticket, channel, weather = impacts.values()
    return changes.withColumns(
        {
            **impacts,
            "composite_gap": traffic + ticket + channel + weather,
            "direction": F.when(F.col("revenue_delta_pct") >= 0, "up").otherwise("down"),
            "drivers": F.transform(
                drivers.getField("name"), lambda name: F.struct(name.alias("name"), values[name].alias("value"))
            ),
        }
    )


def hourly_trend(sales: DataFrame, keys: Sequence[str] = (), *, amount_scale: int | None = AMOUNT_SCALE) -> DataFrame:
    """Per hour: revenue mean, sum and count, centred 3-row moving average, and the peak flag.

    The windows run over at most one row per hour of a group, after the aggregation.
    """
    revenue = F.col("revenue")
    hours = all_present(sales, [*keys, "hour"]).groupBy(*keys, "hour").agg(
        money_mean(revenue, amount_scale).alias("mean_revenue"),
        money_sum(revenue, amount_scale).alias("sum_revenue"),
        F.count(revenue).alias("sale_count"),
    )
    around = Window.partitionBy(*keys).orderBy("hour").rowsBetween(-1, 1)
    whole = Window.partitionBy(*keys)
    return (
        hours.withColumn("moving_avg", F.avg("sum_revenue").over(around))
        .withColumn("peak_from", F.percentile("sum_revenue", PEAK_SHARE).over(whole))
        .withColumn("is_peak", F.col("sum_revenue") >= F.col("peak_from"))
        .drop("peak_from")
    )


def hourly_trend_summary(trend: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per group: peak_hours ascending, best_hour, worst_hour (earliest on ties), volatility, summary text."""
    total = F.col("sum_revenue")
    mean = F.avg(total)
    volatility = F.when(mean > 0, F.stddev_samp(total) / F.nullif(mean, F.lit(0.0))).otherwise(0.0)
    summary = trend.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("is_peak"), F.col("hour")))).alias("peak_hours"),
        F.max_by("hour", F.struct(total, -F.col("hour"))).alias("best_hour"),
        F.min_by("hour", F.struct(total, F.col("hour"))).alias("worst_hour"),
        volatility.alias("volatility"),
        F.count("*").alias("_hours"),
    )
    text = fmt(fv.HOURLY_SUMMARY, F.concat_ws(", ", F.col("peak_hours").cast("array<string>")), F.col("best_hour"))
    return summary.filter(F.col("_hours") > 0).drop("_hours").withColumn("summary", text)
