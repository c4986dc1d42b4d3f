"""Lexicon tables against chains of `contains`."""

import random

from conftest import rows
from pyspark.sql import functions as F

from tillsight import fixed_values as fv
from tillsight.operators import lexicon
from tillsight.operators.lexicon import Automaton, term_hits
from tillsight.operators.notices import policy_flags
from tillsight.operators.reviews import review_sentiment


def drawn_terms(n, seed=1):
    draw = random.Random(seed)
    return [("".join(draw.choice("abcé ") for _ in range(draw.randint(1, 6))), draw.choice(["x", "y"])) for _ in range(n)]


def test_many_terms_against_contains(spark, monkeypatch):
    terms = drawn_terms(3000) + [("", "y"), ("a.b", "x"), ("배달", "x"), ("배달이", "y")]
    draw = random.Random(2)
    texts = [(k, "".join(draw.choice("abcé .배달이") for _ in range(draw.randint(0, 80))), 7) for k in range(60)] + [(100, None, 7), (101, "", 7)]
    table = spark.createDataFrame(texts, "id int, text string, HITS int")
    words = spark.createDataFrame(terms + [terms[0], (None, "x"), ("b", None)], "term string, group string")
    expected = {}
    for k, text, _ in texts:
        counts = {g: len({t for t, own in terms if own == g and t in text}) for g in "xy"} if text is not None else {}
        expected[k] = {g: n for g, n in counts.items() if n}
    for size in (32 << 20, 2000):
        monkeypatch.setattr(lexicon, "PART_BYTES", size)
        found = term_hits(table, "text", words)
        assert found.columns == ["id", "text", "hits"]
        assert {r["id"]: r["hits"] for r in found.collect()} == expected
    nothing = term_hits(table, "text", words.limit(0))
    assert all(r["hits"] == {} for r in nothing.collect())


def test_each_character_is_read_once():
    """The steps of the automaton do not depend on how many terms it has."""
    text = "z" * 50_000
    for n in (10, 10_000):
        assert Automaton([(f"{chr(97 + k % 25)}{k}", "g") for k in range(n)]).count(text) == {}


def test_sentiment_and_policy_by_lexicon(spark, review_rows):
    words = [(t, "positive") for t in fv.POSITIVE_KEYWORDS] + [(t, "negative") for t in fv.NEGATIVE_KEYWORDS]
    table = spark.createDataFrame(words, "term string, group string")
    assert rows(review_sentiment(review_rows, lexicon=table), "review_id") == rows(review_sentiment(review_rows), "review_id")
    texts = spark.createDataFrame([(f"Ein {t.upper()}!",) for t in fv.BLOCKED_TERMS] + [("nothing",), (None,)], "text string")
    blocked = spark.createDataFrame([(t, "blocked") for t in fv.BLOCKED_TERMS], "term string, group string")
    assert rows(policy_flags(texts, "text", lexicon=blocked), "text") == rows(policy_flags(texts, "text"), "text")
    assert policy_flags(texts, "text", lexicon=blocked).where(F.col("policy_violation")).count() == len(fv.BLOCKED_TERMS)
