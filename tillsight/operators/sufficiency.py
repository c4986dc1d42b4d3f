"""Whether a group has enough days and rows to be analysed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillsight import fixed_values as fv
from tillsight.functions.structs import present, warning
from tillsight.functions.text import fmt
from tillsight.plans.attach import all_present


def sufficiency_warnings(
    days: Column,
    records: Column,
    min_days: int = fv.MIN_ANALYSIS_DAYS,
    min_records: int = fv.MIN_ANALYSIS_RECORDS,
) -> Column:
    short, few = (fv.SUFFICIENCY_MESSAGES[code] for code in ("insufficient_period", "insufficient_records"))
    return present(
        warning(days < min_days, "insufficient_period", fmt(short, F.lit(min_days), days)),
        warning(records < min_records, "insufficient_records", fmt(few, F.lit(min_records), records)),
    )


def window_days(start: Column, end: Column) -> Column:
    """Days of a window, both ends included."""
    return F.datediff(end, start) + 1


def data_sufficiency(
    df: DataFrame,
    keys: Sequence[str],
    date_col: str = "date",
    min_days: int = fv.MIN_ANALYSIS_DAYS,
    min_records: int = fv.MIN_ANALYSIS_RECORDS,
    weight: str | None = None,
) -> DataFrame:
    """Per group: window, day and record counts, warnings and the cold_start flag.

    Rows that were folded before count as many records as `weight` says.
    """
    window = all_present(df, keys).groupBy(*keys).agg(
        F.min(F.col(date_col).cast("date")).alias("window_start"),
        F.max(F.col(date_col).cast("date")).alias("window_end"),
        (F.count("*") if weight is None else F.sum(weight)).alias("record_count"),
    )
    return check_window(window, min_days, min_records)


def check_window(
    df: DataFrame, min_days: int = fv.MIN_ANALYSIS_DAYS, min_records: int = fv.MIN_ANALYSIS_RECORDS
) -> DataFrame:
    """The same checks on rows that already carry window_start, window_end and record_count."""
    days = window_days(F.col("window_start"), F.col("window_end"))
    return (
        df.withColumn("day_count", days)
        .withColumn("warnings", sufficiency_warnings(F.col("day_count"), F.col("record_count"), min_days, min_records))
        .withColumn("cold_start", F.size("warnings") > 0)
    )
