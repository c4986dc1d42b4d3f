"""Typed normalisation of raw text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillsight.functions.structs import present
from tillsight.functions.text import strip
from tillsight.schemas import dataset


def _typed(text: Column, kind: str) -> Column:
    """Typed value, or null when the text does not parse. NaN does not count as a number."""
    if kind == "string":
        return text
    if kind == "whole_price":
        return text.try_cast("double").try_cast("int")
    value = text.try_cast(kind)
    return F.when(~F.isnan(value), value) if kind == "double" else value


def normalize(df: DataFrame, name: str, mode: str = "strict") -> DataFrame:
    """Trim and cast every column of dataset `name`.

    strict:      a blank or unparsable field fails the job with the field's name.
    quarantine:  such fields become null and `reasons` lists them (`missing:x`, `invalid:x`);
                 rows without problems carry an empty list.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError(f"Unknown mode: {mode}")
    values, problems = [], []
    for column, kind in dataset(name).all_columns:
        text = strip(F.col(column))
        blank = F.coalesce(text, F.lit("")) == ""
        value = _typed(text, kind)
        values.append(F.when(~blank, value).alias(column))
        problems.append((column, blank, value.isNull()))
    if mode == "strict":
        first = F.coalesce(
            *[
                F.when(blank, F.lit(f"Missing required field: {column}")).when(
                    bad, F.lit(f"Invalid value in field: {column}")
                )
                for column, blank, bad in problems
            ]
        )
        # As a filter the check covers the whole row, whichever columns are read later.
        return df.filter(F.when(first.isNull(), True).otherwise(F.raise_error(first).cast("boolean"))).select(*values)
    reasons = [
        F.when(blank, F.lit(f"missing:{column}")).when(bad, F.lit(f"invalid:{column}"))
        for column, blank, bad in problems
    ]
    return df.select(*values, present(*reasons).alias("reasons"))
