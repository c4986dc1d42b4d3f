"""Text documents: personal-data masking, policy flags, notice summaries and checklists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillsight import fixed_values as fv
from tillsight.functions.structs import evidence, version
from tillsight.functions.text import contains_any, fmt, mask_personal_data, text_lines, with_safe_text
from tillsight.operators.lexicon import term_hits


def mask_pii(df: DataFrame, column: str, enabled: bool = True) -> DataFrame:
    """Replace personal data in a text column."""
    return df.withColumn(column, mask_personal_data(F.col(column), enabled))


def policy_flags(
    df: DataFrame, column: str, terms: Sequence[str] = fv.BLOCKED_TERMS, lexicon: DataFrame | None = None
) -> DataFrame:
    """Add `policy_violation`: whether the lower-cased text contains a blocked term.

    `lexicon` (columns `term` and `group`, whatever the groups) takes the place of the list.
    """
    if lexicon is not None:
        hits = term_hits(df.withColumn("_lowered", F.lower(F.col(column))), "_lowered", lexicon, output="_hits")
        return hits.withColumn("policy_violation", F.size("_hits") > 0).drop("_lowered", "_hits")
    # Lower-cased in a column of its own, so that it happens once for all terms.
    lowered = df.withColumn("_lowered", F.lower(F.col(column)))
    found = contains_any(F.col("_lowered"), terms)
    return lowered.withColumn("policy_violation", F.coalesce(found, F.lit(False))).drop("_lowered")


def require_policy_safe(df: DataFrame, column: str, terms: Sequence[str] = fv.BLOCKED_TERMS) -> DataFrame:
    """The same rows; a text with a blocked term fails the job."""
    return with_safe_text(df, column, F.col(column), masking=False, terms=terms)


def notice_summary(
    notices: DataFrame, *, masking: bool = True, terms: Sequence[str] = fv.BLOCKED_TERMS, policy: str = "raise"
) -> DataFrame:
    """Add summary, confidence, version and, with lineage columns, evidence to rows with `notice_text`.

    The summary is the first two non-blank lines, cut to 180 characters, masked and policy-checked:
    a blocked term fails the job (`policy="raise"`) or sets `policy_violation` (`policy="flag"`).
    A boolean `from_file` column, if present, lowers the confidence of file uploads.
    """
    # One column per step: each is read more than once below and must not be worked out again.
    lines, head = F.col("_lines"), F.col("_head")
    first = F.left(F.array_join(F.slice(lines, 1, fv.NOTICE_SUMMARY_LINES), " "), F.lit(fv.NOTICE_SUMMARY_CHARS))
    opened = notices.withColumn("_lines", text_lines(F.col("notice_text"))).withColumn(
        "_head", F.when(F.size(lines) > 0, first).otherwise(fv.EMPTY_NOTICE)
    )
    confidence = F.lit(fv.NOTICE_CONFIDENCE_TEXT)
    if "from_file" in notices.columns:
        confidence = F.when(F.col("from_file"), fv.NOTICE_CONFIDENCE_FILE).otherwise(confidence)
    if policy == "raise":
        checked = with_safe_text(opened, "summary", head, masking, terms)
    else:
        checked = policy_flags(opened.withColumn("summary", mask_personal_data(head, masking)), "summary", terms)
    result = (
        checked.drop("_lines", "_head")
        .withColumn("ocr_confidence", confidence)
        .withColumn("version", version("ocr"))
    )
    if {"source_name", "uploaded_at"} <= set(notices.columns):
        size = fmt("%d자", F.length(F.coalesce(F.col("notice_text"), F.lit(""))))
        result = result.withColumn(
            "evidence", F.array(evidence("text_length", size, fv.EVIDENCE_PERIODS["upload"]))
        )
    return result


def notice_checklist(
    notices: DataFrame, id_cols: Sequence[str] = ("source_name",), tokens: Sequence[str] = fv.NOTICE_TOKENS
) -> DataFrame:
    """One row per required line: lines with a token, or the first line of a notice without any."""
    marked = notices.select(*id_cols, text_lines(F.col("notice_text")).alias("lines")).withColumn(
        "required", F.filter("lines", lambda line: contains_any(line, tokens))
    )
    items = F.when(F.size("required") > 0, F.col("required")).otherwise(F.slice("lines", 1, 1))
    return marked.select(*id_cols, F.posexplode(items).alias("position", "item")).select(
        *id_cols,
        "position",
        "item",
        F.lit(fv.NOTICE_DEADLINE).alias("deadline"),
        F.lit(fv.NOTICE_ASSIGNEE).alias("assignee"),
    )
