"""Keyword sentiment of review texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillsight import fixed_values as fv
from tillsight.functions.numeric import rounded
from tillsight.functions.text import keyword_hits, strip
from tillsight.operators.lexicon import term_hits

# Confidence of a text without a majority, step per hit and its limit.
BASE_CONFIDENCE = 0.55
HIT_STEP = 0.1
HIT_LIMIT = 0.35


def review_sentiment(
    df: DataFrame,
    text_col: str = "review_text",
    positive: Sequence[str] = fv.POSITIVE_KEYWORDS,
    negative: Sequence[str] = fv.NEGATIVE_KEYWORDS,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """Add sentiment and confidence from the number of positive and negative keywords in the text.

    `lexicon` (columns `term` and `group`, the groups `positive` and `negative`) takes the place of the two lists; thousands
    of terms are then looked for in one pass over the text.
    """
    lowered = F.lower(strip(F.coalesce(F.col(text_col), F.lit(""))))
    liked, disliked = F.col("_liked"), F.col("_disliked")
    confidence = rounded(F.lit(BASE_CONFIDENCE) + F.least(F.greatest(liked, disliked) * HIT_STEP, F.lit(HIT_LIMIT)), 2)
    rows = df.withColumn("_text", lowered)
    if lexicon is None:
        rows = rows.withColumns({"_liked": keyword_hits(F.col("_text"), positive), "_disliked": keyword_hits(F.col("_text"), negative)})
    else:
        counted = {name: F.coalesce(F.try_element_at("_hits", F.lit(group)), F.lit(0)) for name, group in (("_liked", "positive"), ("_disliked", "negative"))}
        rows = term_hits(rows, "_text", lexicon, output="_hits").withColumns(counted).drop("_hits")
    return (
        rows.withColumn(
            "sentiment",
            F.when(liked > disliked, "positive").when(disliked > liked, "negative").otherwise("neutral"),
        )
        .withColumn("confidence", F.when(liked != disliked, confidence).otherwise(BASE_CONFIDENCE))
        .drop("_text", "_liked", "_disliked")
    )
