"""License notices in documents: phrases word by word, and templates by an exact set-similarity join.

The words of the templates are counted over the whole corpus and ordered from rare to frequent. A text that holds enough
of a template shares one of the template's rarest words with it; texts and templates meet on these words and are cut by
length and position. What is left is verified on blocks: all windows of a template's length over the words of the whole text,
over line breaks too, as notices are wrapped.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillsight.llm.common import sent_if_small, table, without
from tillsight.plans.shared import stored

# Phrases of the base labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Notices that licenses ask to be put on a work, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Released under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

CONTAINMENT = 0.9
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(r"[a-z0-9]+", text.lower())))


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, letters a-z and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _NO_WORD), "")


def word_ranks(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary from rare to frequent in all of `words`, a table of word arrays; ties by the word."""
    asked = words.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    # explode_outer: a plain one is given a filter on its array, for which the words would be split again.
    counts = words.select(F.explode_outer("words").alias("word")).join(F.broadcast(asked), "word").groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def held_templates(documents: DataFrame, doc_id: str, text: str, sets: list[list[str]], needs: list[int]) -> tuple[DataFrame, list[str]]:
    """`doc_id`, `row` (hash of the text) and `template` where the whole text holds enough of a template's words, and
    the templates' words from rare to frequent."""
    spark = documents.sparkSession
    value = F.col(f"`{text}`")
    texts = documents.where(value.isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(value).alias("row"), words_of(value).alias("words"))
    order = word_ranks(texts.select("words"), sorted({w for words in sets for w in words}))
    rank = {w: i for i, w in enumerate(order)}
    prefixes, whole = [], []
    for number, (words, need) in enumerate(zip(sets, needs)):
        ranks = sorted(rank[w] for w in words)
        whole.append((number, ranks, need))
        prefixes += [(r, number, i, len(ranks), need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    first = F.broadcast(spark.createDataFrame(prefixes, "rank int, template int, place int, size int, need int"))
    all_of = F.broadcast(spark.createDataFrame(whole, "template int, ranks array<int>, need int"))
    ordered = F.array(*map(F.lit, order))
    # Only words of the templates can be shared; a text with too few of them is left before it is taken apart.
    known = F.array_intersect("words", ordered)
    held = texts.withColumn("known", known).where(F.size("known") >= min(needs))
    held = held.select("doc_id", "row", F.sort_array(F.transform("known", lambda w: (F.array_position(ordered, w) - 1).cast("int"))).alias("held"))
    met = held.select("doc_id", "row", "held", F.posexplode_outer("held").alias("at", "rank")).join(first, "rank")
    fits = (F.size("held") >= F.col("need")) & (F.least(F.size("held") - F.col("at"), F.col("size") - F.col("place")) >= F.col("need"))
    pairs = met.where(fits).select("doc_id", "row", "held", "template").distinct()
    enough = pairs.join(all_of, "template").where(F.size(F.array_intersect("held", "ranks")) >= F.col("need"))
    return enough.select("doc_id", "row", "template"), order


def window_words(words: int) -> int:
    """Words of the block in which a template of so many words is looked for: a tenth more."""
    return words + -(-words // 10)


def template_blocks(documents: DataFrame, doc_id: str, text: str, templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """`doc_id`, `row` (hash of the text), `labels` and `score` of the rows in which a block holds a template.

    A block is any run of consecutive words of the whole text that is a tenth longer than the template, whatever lines it
    runs over. It holds the template if it has at least the share `containment` of its distinct words. The score is
    the largest such share of a template that is held.

    A word counts once in a block. So each place of a word of the template counts for the blocks that start after the word's
    place before and reach this one: a stretch of starts. How many stretches lie over a start is a running sum, and a
    text costs no more than its places sorted.
    """
    spark = documents.sparkSession
    share = Fraction(str(containment))
    value = F.col(f"`{text}`")
    sets = [template_words(t) for _, t in templates]
    needs = [_part(len(words), share) for words in sets]
    found, _ = held_templates(documents, doc_id, text, sets, needs)
    asked = found.groupBy("doc_id", "row").agg(F.collect_set("template").alias("templates"))
    met = sent_if_small(stored(asked.select(F.col("doc_id").alias("met_id"), F.col("row").alias("met_row"), "templates"), "license-texts"))
    parts = [
        (word, number, window_words(len(re.findall(r"[a-z0-9]+", notice.lower()))))
        for number, ((_, notice), words) in enumerate(zip(templates, sets, strict=True))
        for word in words
    ]
    known = F.broadcast(spark.createDataFrame(parts, "word string, template int, span int"))
    wanted = F.broadcast(
        spark.createDataFrame(
            [(n, label, len(words), need) for n, ((label, _), words, need) in enumerate(zip(templates, sets, needs, strict=True))],
            "template int, label string, size int, need int",
        )
    )
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("met_id")) & (F.xxhash64(value) == F.col("met_row"))
    texts = documents.select(F.col(f"`{doc_id}`"), value).join(met, same)
    texts = texts.select(F.col("met_id").alias("doc_id"), F.col("met_row").alias("row"), "templates", value.alias("value")).dropDuplicates(["doc_id", "row"])
    # Only the templates' words and their places leave a text.
    vocabulary = F.array(*map(F.lit, sorted({word for word, _, _ in parts})))
    numbered = F.transform(words_of(F.col("value")), lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    texts = texts.select("doc_id", "row", "templates", F.filter(numbered, lambda x: F.array_contains(vocabulary, x["word"])).alias("words"))
    words = texts.select("doc_id", "row", "templates", F.inline("words"))
    places = words.join(known, "word").where(F.array_contains("templates", F.col("template"))).select("doc_id", "row", "template", "word", "span", "pos")
    one = ["doc_id", "row", "template"]
    before = F.lag("pos").over(Window.partitionBy(*one, "word").orderBy("pos"))
    first = F.greatest(F.coalesce(before + 1, F.lit(0)), F.col("pos") - F.col("span") + 1, F.lit(0))
    ends = F.array(F.struct(first.alias("at"), F.lit(1).alias("step")), F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("step")))
    steps = places.select(*one, ends.alias("ends")).select(*one, F.inline("ends"))
    # Ordered by place alone, the default frame takes all steps of a place together.
    running = steps.withColumn("held", F.sum("step").over(Window.partitionBy(*one).orderBy("at")))
    most = running.groupBy(*one).agg(F.max("held").alias("held")).join(wanted, "template").where(F.col("held") >= F.col("need"))
    return most.groupBy("doc_id", "row").agg(F.collect_set("label").alias("labels"), F.max(F.col("held") / F.col("size")).alias("score"))


def _part(count: int, share: Fraction) -> int:
    return -(-count * share.numerator // share.denominator)


def phrase_places(words: str, phrases: dict[str, str]) -> Column:
    """Places (`at`, `label`) in the column `words` where a phrase's words stand one after another."""

    def at(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def stands(i: Column) -> Column:
            return _all([F.get(words, i + k) == F.lit(w) for k, w in enumerate(parts)])

        starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)
        possible = F.size(words) >= len(parts)
        for w in parts:
            possible &= F.array_contains(words, w)
        places = F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))
        return F.when(possible, places).otherwise(F.expr("cast(array() as array<struct<at:bigint,label:string>>)"))

    return F.concat(*(at(p, label) for p, label in phrases.items()))


def _all(parts: list[Column]) -> Column:
    result = parts[0]
    for part in parts[1:]:
        result &= part
    return result


def scan_licenses(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Every row with `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`.

    Base places are all starts of a phrase among the words of the whole text, from 0; overlapping and repeated
    ones count. `labels` adds those of the templates of which one block holds at least the share `containment` of
    the distinct words: a run of words a tenth longer than the template, over any line breaks (`template_blocks`). The score is 1 with a base place, else the largest such share, else 0. A null or empty text has no
    words, no labels (empty strings) and score 0. Rows equal in id and text get the same result; an empty
    table stays empty. Columns named like a result are replaced, others stay.
    """
    base = without(documents, RESULTS)
    value = F.col(f"`{text}`")
    found = stored(template_blocks(base, doc_id, text, TEMPLATES if templates is None else templates, containment), "license-blocks")
    found = found.select(F.col("doc_id").alias("__llm_id"), F.col("row").alias("__llm_row"), F.col("labels").alias("__llm_labels"), F.col("score").alias("__llm_score"))
    worded = base.withColumns({"__llm_words": words_of(F.coalesce(value, F.lit(""))), "__llm_row": F.xxhash64(value)})
    places = phrase_places("__llm_words", PHRASES if phrases is None else phrases)
    placed = worded.withColumns({"__llm_places": places, "n_words": F.size("__llm_words").cast("bigint")}).drop("__llm_words")
    starts = F.transform("__llm_places", lambda p: p["at"])
    names = F.array_sort(F.array_distinct(F.transform("__llm_places", lambda p: p["label"])))
    described = placed.withColumns(
        {
            "n_base": F.size("__llm_places").cast("bigint"),
            "first_word": F.array_min(starts),
            "last_word": F.array_max(starts),
            "__llm_names": names,
        }
    ).drop("__llm_places")
    same = F.col(f"`{doc_id}`").eqNullSafe(found["__llm_id"]) & (described["__llm_row"] == found["__llm_row"])
    joined = described.join(found, same, "left").drop(found["__llm_row"])
    none = F.expr("cast(array() as array<string>)")
    return joined.withColumns(
        {
            "base_labels": F.array_join("__llm_names", ","),
            "labels": F.array_join(F.array_sort(F.array_union("__llm_names", F.coalesce("__llm_labels", none))), ","),
            "score": F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("__llm_score", F.lit(0.0))),
        }
    ).drop("__llm_id", "__llm_row", "__llm_names", "__llm_labels", "__llm_score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places, labels and score of every document."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULTS)


def _phrase_sql() -> str:
    def starts(phrase: str, label: str) -> str:
        parts = phrase.split()
        same = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        return f"[{{'at': i - 1, 'label': '{label}'}} for i in range(1, len(w) - {len(parts)} + 2) if {same}]"

    return " || ".join(starts(p, label) for p, label in PHRASES.items())


_SQL_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7_SQL = f"""
with templates as (
    select *, len(tw) as size from (
        select unnest({list(range(len(TEMPLATES)))}) as t, unnest({[label for label, _ in TEMPLATES]}) as label,
            unnest({[template_words(t) for _, t in TEMPLATES]}) as tw,
            unnest({[window_words(len(re.findall("[a-z0-9]+", t.lower()))) for _, t in TEMPLATES]}) as span)
), docs as (
    select row_number() over () as r, doc_id, text,
        coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_SQL_WORDS}'), []) as w
    from documents
), met as (
    select r, w, t, label, tw, size, span from docs, templates where 10 * len(list_intersect(list_distinct(w), tw)) >= 9 * size
), hits as (
    select r, t, any_value(label) as label, any_value(size) as size, any_value(span) as span, pos, any_value(word) as word
    from (select *, unnest(w) as word, generate_subscripts(w, 1) as pos from met) where list_contains(tw, word) group by r, t, pos
), windows as (
    select a.r, a.t, a.label, a.size, a.pos, count(distinct b.word) as n
    from hits a join hits b on a.r = b.r and a.t = b.t and b.pos between a.pos and a.pos + a.span - 1 group by all
), found as (
    select r, list_distinct(list(label)) as labels, max(n / size) as score from windows where 10 * n >= 9 * size group by r
), places as (
    select r, doc_id, len(w) as n_words, {_phrase_sql()} as p from docs
)
select doc_id, cast(n_words as bigint) as n_words, cast(len(p) as bigint) as n_base,
    list_min([x['at'] for x in p]) as first_word, list_max([x['at'] for x in p]) as last_word,
    coalesce(array_to_string(list_sort(list_distinct([x['label'] for x in p])), ','), '') as base_labels,
    coalesce(array_to_string(list_sort(list_distinct([x['label'] for x in p] || coalesce(f.labels, []))), ','), '') as labels,
    case when len(p) > 0 then 1.0::double else coalesce(f.score, 0.0::double) end as score
from places left join found f using (r)
"""
