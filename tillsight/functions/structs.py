"""Nested columns shared by the reports: evidence, version stamps, warnings, steps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillsight import fixed_values as fv

WARNING_TYPE = "array<struct<code:string,message:string>>"


def evidence(label: str, value: Column, period: Column | str) -> Column:
    """One evidence entry; expects `source_name` and `uploaded_at` on the row."""
    return F.struct(
        F.lit(fv.EVIDENCE_LABELS[label]).alias("metric"),
        value.alias("value"),
        (F.lit(period) if isinstance(period, str) else period).alias("period"),
        F.struct(
            F.col("source_name").cast("string").alias("name"),
            F.col("uploaded_at").cast("timestamp").alias("uploaded_at"),
        ).alias("source"),
    )


def version(agent: str) -> Column:
    if agent not in fv.VERSIONS:
        raise KeyError(f"Unknown agent: {agent}")
    model, prompt, post = fv.VERSIONS[agent]
    return F.struct(
        F.lit(agent).alias("agent"),
        F.lit(model).alias("model_version"),
        F.lit(prompt).alias("prompt_version"),
        F.lit(post).alias("postprocess_version"),
    )


def warning(condition: Column, code: str, message: Column) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), message.alias("message")))


def present(*entries: Column) -> Column:
    """Array of the entries that are not null, in order."""
    return F.array_compact(F.array(*entries))


def typed_text(kind: str, title: Column | str, description: Column | str) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        (F.lit(title) if isinstance(title, str) else title).alias("title"),
        (F.lit(description) if isinstance(description, str) else description).alias("description"),
    )


def ranked(entries: list[tuple[Column | str, Column]]) -> Column:
    """Array of (name, value) structs from highest value to lowest; equal values keep list order."""
    return F.array_sort(
        F.array(
            *[
                F.struct(
                    (-value).alias("rank"),
                    F.lit(position).alias("position"),
                    (F.lit(name) if isinstance(name, str) else name).alias("name"),
                )
                for position, (name, value) in enumerate(entries)
            ]
        )
    )
