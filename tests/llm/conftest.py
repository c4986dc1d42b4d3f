"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats and clashing column names."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 997} of{i % 31}" for i in range(30_000))
PLAIN = "The quick brown fox jumps over the lazy dog and runs away from here.\nA second line follows the first one here."


@pytest.fixture(scope="session")
def edge(spark):
    """Columns named like those the operators work with; ids 1 (twice, repeated) and none (twice) occur."""
    rows = [
        (1, PLAIN, "en", "a", 1.5),
        (1, PLAIN, "en", "a", 1.5),
        (2, None, "en", "a", None),
        (3, "", None, "a", 0.5),
        (4, " \n\t ", "en", None, 0.5),
        (5, PLAIN, "fr", "b", 0.5),
        (None, "text without an id", "en", "b", 0.5),
        (None, None, None, None, None),
        (7, LONG, "en", "b", 0.5),
        (8, "12 34 !!", "de", "b", 0.5),
        (9, "çé ñandú über 東京", "es", "b", 0.5),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double").selectExpr(
        "*", "7 as n_words", "'x' as row", "'y' as key", "3 as _gone", "4 as shard", "'z' as ids", "1 as N_TOKENS"
    )


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
