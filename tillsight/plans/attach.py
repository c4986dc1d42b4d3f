"""Put group statistics next to the rows they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillsight.plans.shared import stored


def all_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose key columns are all set; null keys never form a group."""
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def grouped(df: DataFrame, keys: Sequence[str], *aggregates) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add the columns of `stats` to every row of `df`.

    Without keys `stats` is a global aggregate of exactly one row and arrives as a scalar subquery:
    no join, no broadcast. With keys it is written to the shared folder first and joined without a
    hint: Spark knows its real size, broadcasts it below the session's threshold so that `df` is not
    shuffled, and otherwise shuffles both sides and splits skewed keys at run time. Rows whose keys have no
    statistics stay, with nulls.
    """
    if keys:
        return df.join(stored(stats, "group-statistics"), list(keys), "left")
    return attach_one_row(df, stats)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row of `df`."""
    added = list(one_row.columns)
    value = one_row.select(F.struct(*added).alias("_stats")).scalar()
    return df.withColumn("_stats", value).select(
        *df.columns, *[F.col("_stats").getField(name).alias(name) for name in added]
    )
