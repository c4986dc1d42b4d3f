"""Percentiles of any number of values: from a quantile sketch, or exact.

Spark's `percentile` keeps every distinct value of a group in one task. Here a mergeable sketch gives a value on either side
of the wanted rank, and a second pass counts the few values between them one by one, all below and all above together. Where
even those are many, their table (not the input) is narrowed by counting ranges of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillsight.plans.attach import all_present, attach, attach_one_row, grouped
from tillsight.plans.shared import stored

#: Distinct values a window takes per group, and ranges a narrowing pass counts.
FANOUT = 1 << 16
#: The sketch is off by at most one rank in this many; the bracket reaches out by twice that.
ACCURACY = 10_000


def exact_percentile(
    df: DataFrame,
    value: str,
    fraction: float,
    keys: Sequence[str] = (),
    *,
    output: str = "percentile",
    approx: bool = False,
    accuracy: int = ACCURACY,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per group (one row without keys): the linearly interpolated percentile of `value`.

    Null and non-finite values do not count; a group without others has a null percentile. `df` is read twice, whatever its
    values: once for the sketch, once to count the values around the wanted rank. With `approx` it is read once and the result is
    the sketch's value: one of the group's, at most one rank in `accuracy` away from the wanted one, not interpolated.
    """
    number = F.col(value).cast("double")
    finite = F.abs(number) < F.lit(float("inf"))
    rows = all_present(df, keys).select(*keys, F.when(finite, number).alias("_v"))
    if approx:
        return grouped(rows, keys, F.percentile_approx("_v", F.lit(fraction), F.lit(accuracy)).alias(output))
    bracket = grouped(rows, keys, _ends(fraction, accuracy).alias("_ends"))
    folded = stored(_folded(attach(rows, bracket, keys), keys), "percentile-values")
    most, missed = _size(folded, keys, fraction)
    if missed:  # the sketch was further off than it promises: count ranges of the whole input
        found = _by_narrowing(rows.withColumn("_n", F.when(F.col("_v").isNotNull(), 1).otherwise(0)), keys, fraction, fanout)
    elif most > fanout:
        nearest = F.when(F.col("_zone") < 0, F.col("_most")).otherwise(F.col("_least"))
        found = _by_narrowing(folded.select(*keys, nearest.alias("_v"), "_n"), keys, fraction, fanout)
    else:
        found = _picked(folded, keys, fraction)
    return found.select(*keys, F.col("_value").alias(output))


def _ends(fraction: float, accuracy: int) -> Column:
    """Values of the sketch on either side of the wanted rank."""
    margin = 2 / accuracy
    around = F.array(F.lit(max(0.0, fraction - margin)), F.lit(min(1.0, fraction + margin)))
    return F.percentile_approx("_v", around, F.lit(accuracy))


def _folded(beside: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of each value between the ends, of all below (zone -1) and of all above (zone 1); nulls (zone -2) count 0."""
    low, high = F.col("_ends")[0], F.col("_ends")[1]
    zone = F.when(F.col("_v").isNull(), -2).when(F.col("_v") < low, -1).when(F.col("_v") > high, 1).otherwise(0)
    return beside.groupBy(*keys, zone.alias("_zone"), F.when(zone == 0, F.col("_v")).alias("_one")).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )


def _size(folded: DataFrame, keys: Sequence[str], fraction: float) -> tuple[int, bool]:
    """Rows of the largest group, and whether a wanted rank lies among values that were counted together."""
    below, inside = (F.sum(F.when(F.col("_zone") == z, F.col("_n")).otherwise(0)) for z in (-1, 0))
    target = (F.sum("_n") - 1) * F.lit(fraction)
    inner = (F.floor(target) >= below - 1) & (F.ceil(target) <= below + inside)
    groups = grouped(folded, keys, F.count("*").alias("_rows"), (~inner & (F.sum("_n") > 0)).alias("_missed"))
    row = groups.agg(F.max("_rows"), F.bool_or("_missed")).first()
    return row[0] or 0, bool(row[1])


def _picked(folded: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """`_value` per group, from at most `fanout` rows of each: the last of those below and the first above count as values."""
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    order = group.orderBy("_zone", "_one")
    target = (F.sum("_n").over(group) - 1) * F.lit(fraction)
    placed = folded.select(
        *keys, "_n", F.when(F.col("_zone") < 0, F.col("_most")).otherwise(F.col("_least")).alias("_low"),
        F.floor(target).alias("_rank"), (target - F.floor(target)).alias("_part"),
        F.sum("_n").over(order).alias("_upto"), F.lead("_least").over(order).alias("_next"),
    )
    upper = F.when(F.col("_rank") + 1 < F.col("_upto"), F.col("_low")).otherwise(F.coalesce("_next", "_low"))
    hit = (F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank"))
    value = F.when(hit, _interpolated(F.col("_low"), upper, F.col("_part")))
    return grouped(placed.withColumn("_value", value), keys, F.max("_value").alias("_value"))


def _interpolated(low: Column, high: Column, part: Column) -> Column:
    return low + part * (high - low)


def _by_narrowing(rows: DataFrame, keys: Sequence[str], fraction: float, fanout: int) -> DataFrame:
    """`_value` per group by narrowing the range that holds the wanted rank until it is one value wide.

    `rows` has values `_v` and how often they occur, `_n`; each pass counts at most `fanout` ranges per group.
    """
    target = (F.sum("_n") - 1) * F.lit(fraction)
    state = grouped(
        rows,
        keys,
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
        F.sum("_n").alias("_here"),
        F.floor(target).alias("_rank"),
        (target - F.floor(target)).alias("_part"),
    ).withColumn("_after", F.lit(None).cast("double"))
    state = stored(state, "percentile-bounds")
    while state.filter("_low < _high").limit(1).count():
        settled = state.filter("_low = _high or _low is null")
        state = stored(settled.unionByName(_narrow(rows, state.filter("_low < _high"), keys, fanout)), "percentile-range")
    upper = F.when(F.col("_rank") + 1 < F.col("_here"), F.col("_low")).otherwise(F.coalesce("_after", "_low"))
    return state.select(*keys, _interpolated(F.col("_low"), upper, F.col("_part")).alias("_value"))


def _narrow(values: DataFrame, state: DataFrame, keys: Sequence[str], fanout: int) -> DataFrame:
    """The sub-range of each group that holds the wanted rank, with the rank counted from its start.

    Ranges follow each other as their values do, and the least and the largest value never share one, so every
    pass makes progress.
    """
    beside = values.join(state, list(keys)) if keys else attach_one_row(values, state)
    # Halves first: the distance of two finite values can be infinite.
    share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
    slot = F.when(F.col("_v") == F.col("_high"), fanout).otherwise(F.least(F.floor(share * fanout), F.lit(fanout - 1)))
    counts = (
        beside.filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        .groupBy(*keys, slot.alias("_slot"), "_rank", "_part", "_after")
        .agg(F.sum("_n").alias("_count"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    )
    running = Window.partitionBy(*keys).orderBy("_slot")
    upto = F.sum("_count").over(running)
    return (
        counts.withColumns({"_upto": upto, "_next": F.lead("_least").over(running)})
        .filter((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_count") <= F.col("_rank")))
        .select(
            *keys,
            F.col("_least").alias("_low"),
            F.col("_most").alias("_high"),
            F.col("_count").alias("_here"),
            (F.col("_rank") - (F.col("_upto") - F.col("_count"))).alias("_rank"),
            "_part",
            F.coalesce("_next", "_after").alias("_after"),
        )
    )
