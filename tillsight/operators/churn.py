"""Customer churn: recency/frequency/money features, segments and a weighted risk score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType

from tillsight.functions.numeric import AMOUNT_SCALE, at_least, at_most, band, clamp, floor_days, money_sum, rounded
from tillsight.plans.attach import all_present, attach, grouped
from tillsight.plans.percentiles import exact_percentile
from tillsight.plans.shared import stored

# Weights and cuts of the risk score, defaults of the segment rules.
RISK_CUTS = [(65, "high"), (40, "medium")]
DEFAULT_INTERVAL_DAYS = 30
INTERVAL_FACTOR = 1.5
AT_RISK_PROBABILITY = 0.8
LOST_DAYS = 90
VIP_VISITS = 5
LOYAL_VISITS = 2


def churn_score(
    df: DataFrame,
    *,
    recency_days: float = 60.0,
    visits: float = 10.0,
    weights: tuple[float, float, float] = (50, 30, 20),
    cuts: Sequence[tuple[float, str]] = RISK_CUTS,
) -> DataFrame:
    """Add `churn_score` (0-100) and `risk_level` from recency, frequency and coupon_use_rate."""
    away = at_most(F.col("recency") / F.lit(recency_days), 1.0) * weights[0]
    rare = at_least(1.0 - F.col("frequency") / F.lit(visits), 0.0) * weights[1]
    unmoved = (1.0 - F.col("coupon_use_rate")) * weights[2]
    scored = df.withColumn("churn_score", rounded(away + rare + unmoved, 2))
    return scored.withColumn("risk_level", band(F.col("churn_score"), list(cuts), "low"))


def rfm(
    visits: DataFrame,
    reference: object | None = None,
    keys: Sequence[str] = (),
    *,
    amount_scale: int | None = AMOUNT_SCALE,
    also: Sequence[Column] = (),
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Per customer: recency, frequency, monetary, avg_interval, churn_probability.

    `visits` has customer_id, visit_date (date or timestamp) and payment_amount. `reference` is the
    day recency is counted to (column, date or text); without it the latest visit is used. With
    `keys` every statistic is per group, e.g. per store.

    The visits are scanned once; the per-customer table is written to the shared folder and the
    statistics over all customers are taken from there. `also` are named aggregates of a customer's visits (by date) that
    are taken in the same scan and added to the result. `lookup` (customer_id and one row each with `keys`) gives the keys
    to visits that do not have them: visits are folded to customers before they meet it, those of others are left out.
    """
    given = [*(() if lookup is not None else keys), "customer_id"]
    visits = all_present(visits, given)
    by_date = isinstance(visits.schema["visit_date"].dataType, DateType)
    if also and not by_date:
        raise ValueError("more aggregates need visits by date")
    folded = _customers_by_date(visits, given, amount_scale, also) if by_date else _customers_by_timestamp(visits, given, amount_scale)
    if lookup is not None:
        folded = folded.join(all_present(lookup, keys).select("customer_id", *keys), "customer_id")
    customers = stored(folded, "customers")
    added = [c for c in customers.columns if c not in {*keys, "customer_id", "last_visit", "frequency", "monetary", "own_interval"}]

    statistics = grouped(
        customers,
        keys,
        F.avg("own_interval").alias("_mean_interval"),
        F.max("last_visit").alias("_latest"),
    )
    until = F.col("_latest") if reference is None else _point(reference, by_date)
    rows = attach(customers, statistics, keys)
    recency = F.datediff(until, F.col("last_visit")) if by_date else floor_days(until, F.col("last_visit"))
    rows = rows.withColumn("recency", recency).withColumn(
        "avg_interval",
        F.coalesce(F.col("own_interval"), F.col("_mean_interval"), F.lit(float(DEFAULT_INTERVAL_DAYS))),
    )
    return rows.select(
        *keys,
        "customer_id",
        "recency",
        "frequency",
        "monetary",
        "avg_interval",
        _overdue(F.col("recency"), F.col("avg_interval")).alias("churn_probability"),
        *added,
    )


def _point(reference: object, by_date: bool) -> Column:
    point = reference if isinstance(reference, Column) else F.lit(reference)
    return point.cast("date" if by_date else "timestamp")


def _overdue(recency: Column, interval: Column) -> Column:
    """recency / (1.5 x interval) limited to 0..1; a zero interval gives 1, 0 or null by sign of recency."""
    return F.when(
        interval == 0,
        F.when(recency > 0, F.lit(1.0)).when(recency < 0, F.lit(0.0)),
    ).otherwise(clamp(recency / F.nullif(interval * INTERVAL_FACTOR, F.lit(0.0)), 0.0, 1.0))


def _customers_by_date(visits: DataFrame, customer: list[str], scale: int | None, also: Sequence[Column]) -> DataFrame:
    # Whole-day gaps add up to last - first, so the mean gap needs no ordering of the visits.
    spread = F.datediff(F.max("visit_date"), F.min("visit_date"))
    gaps = F.count("visit_date") - 1
    return visits.groupBy(*customer).agg(
        F.max("visit_date").alias("last_visit"),
        F.count("*").alias("frequency"),
        money_sum(F.col("payment_amount"), scale).alias("monetary"),
        F.when(gaps > 0, spread / gaps).alias("own_interval"),
        *also,
    )


def _customers_by_timestamp(visits: DataFrame, customer: list[str], scale: int | None) -> DataFrame:
    # Two visits on one day are less than a day apart and count as a gap of 0 days, so only the
    # first and last visit of each day matter. Folding to days before ordering keeps a customer
    # with very many visits from being sorted in one task.
    visits = visits.withColumn("visit_date", F.col("visit_date").cast("timestamp"))
    amounts = F.sum(F.col("payment_amount").cast(f"decimal(38,{scale})" if scale is not None else "double"))
    days = visits.groupBy(*customer, F.to_date("visit_date").alias("day")).agg(
        F.min("visit_date").alias("first_visit"),
        F.max("visit_date").alias("last_visit"),
        F.count("*").alias("rows"),
        F.count("visit_date").alias("dated"),
        amounts.alias("amount"),
    )
    before = F.lag("last_visit").over(Window.partitionBy(*customer).orderBy("day"))
    gaps = F.sum("dated") - 1
    return (
        days.withColumn("gap", floor_days(F.col("first_visit"), before))
        .groupBy(*customer)
        .agg(
            F.max("last_visit").alias("last_visit"),
            F.sum("rows").alias("frequency"),
            F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("monetary"),
            F.when(gaps > 0, F.coalesce(F.sum("gap"), F.lit(0)) / gaps).alias("own_interval"),
        )
    )


def rfm_segments(
    customers: DataFrame,
    keys: Sequence[str] = (),
    *,
    at_risk_probability: float = AT_RISK_PROBABILITY,
    lost_days: float = LOST_DAYS,
    vip_visits: float = VIP_VISITS,
    loyal_visits: float = LOYAL_VISITS,
) -> DataFrame:
    """Add `segment` to an `rfm` result: At Risk, Lost, VIP, Loyal or New, first match wins."""
    median = exact_percentile(customers, "monetary", 0.5, keys, output="_median")
    return (
        attach(customers, median, keys)
        .withColumn(
            "segment",
            F.when(F.col("churn_probability") > at_risk_probability, "At Risk")
            .when(F.col("recency") > lost_days, "Lost")
            .when((F.col("frequency") >= vip_visits) & (F.col("monetary") >= F.col("_median")), "VIP")
            .when(F.col("frequency") >= loyal_visits, "Loyal")
            .otherwise("New"),
        )
        .drop("_median")
    )


def segment_summary(segments: DataFrame, keys: Sequence[str] = (), *, amount_scale: int | None = AMOUNT_SCALE) -> DataFrame:
    """Customers, revenue and visits per segment."""
    return segments.groupBy(*keys, "segment").agg(
        F.count("*").alias("customer_count"),
        money_sum(F.col("monetary"), amount_scale).alias("revenue"),
        F.sum("frequency").alias("visit_count"),
    )
