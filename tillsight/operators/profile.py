"""Dataset profiles: row count, numeric ranges, missing counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tillsight.functions.numeric import rounded
from tillsight.functions.text import is_blank
from tillsight.schemas import dataset


def profile(raw: DataFrame, name: str) -> DataFrame:
    """One row per numeric or key column of dataset `name`, from a single pass over raw text rows.

    Numeric columns get count, min, max and mean (4 decimals); key columns get the number of blanks.
    """
    spec = dataset(name)
    aggregates = [F.count("*").alias("row_count")]
    entries = []
    for column in dict.fromkeys(spec.numeric + spec.key_fields):
        numeric, key = column in spec.numeric, column in spec.key_fields
        if numeric:
            value = F.col(column).try_cast("double")
            aggregates += [
                F.count(value).alias(f"{column}_n"),
                F.coalesce(F.min(value), F.lit(0.0)).alias(f"{column}_min"),
                F.coalesce(F.max(value), F.lit(0.0)).alias(f"{column}_max"),
                F.coalesce(rounded(F.avg(value), 4), F.lit(0.0)).alias(f"{column}_mean"),
            ]
        if key:
            aggregates.append(F.count_if(is_blank(F.col(column))).alias(f"{column}_missing"))
        entries.append(
            F.struct(
                F.lit(column).alias("column_name"),
                (F.col(f"{column}_n") if numeric else F.lit(None).cast("bigint")).alias("value_count"),
                (F.col(f"{column}_min") if numeric else F.lit(None).cast("double")).alias("min_value"),
                (F.col(f"{column}_max") if numeric else F.lit(None).cast("double")).alias("max_value"),
                (F.col(f"{column}_mean") if numeric else F.lit(None).cast("double")).alias("mean_value"),
                (F.col(f"{column}_missing") if key else F.lit(None).cast("bigint")).alias("missing_count"),
            )
        )
    return (
        raw.agg(*aggregates)
        .select(F.lit(name).alias("dataset_type"), "row_count", F.explode(F.array(*entries)).alias("entry"))
        .select("dataset_type", "row_count", "entry.*")
    )


def profile_all(raw_tables: dict[str, DataFrame]) -> DataFrame:
    """Profiles of several datasets stacked into one table."""
    return reduce(DataFrame.unionByName, [profile(raw, name) for name, raw in raw_tables.items()])
