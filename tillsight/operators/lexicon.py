"""Term lists of any length, kept as a table and looked for in one pass over the text.

A chain of `contains` reads the text once for every term, which is right for the few fixed keywords of the reports. A lexicon table is
compiled to one automaton over all its terms instead; its cost is that of reading the text and of what is found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from tillsight.plans.shared import stored

#: Bytes of terms sent to the tasks at once; a longer lexicon is looked for part by part.
PART_BYTES = 32 << 20


class Automaton:
    """Finds which of the terms a text holds as substrings, and counts them by group."""

    def __init__(self, terms: list[tuple[str, str]]):
        groups: dict[str, list[str]] = {}
        for term, group in sorted(set(terms)):
            groups.setdefault(term, []).append(group)
        self.always = groups.pop("", [])  # the empty term is in every text
        self.found = ahocorasick.Automaton()
        for term, own in groups.items():
            self.found.add_word(term, (term, own))
        if groups:
            self.found.make_automaton()
        self.empty = not groups

    def count(self, text: str | None) -> dict[str, int]:
        if text is None:
            return {}
        counts = Counter(self.always)
        if not self.empty:
            for _, own in dict(value for _, value in self.found.iter(text)).items():
                counts.update(own)
        return dict(counts)


def term_hits(df: DataFrame, text: str, lexicon: DataFrame, *, term: str = "term", group: str = "group", output: str = "hits") -> DataFrame:
    """Add `output`: a map from group to how many of its distinct terms occur in the text as substrings.

    Groups without a hit are not in the map; a null text has an empty one. Null terms and groups are left out, repeated
    terms count once, a term can belong to several groups. The lexicon is written once and sent to the tasks in parts of
    PART_BYTES, so that it may be of any size; each part is one pass over the texts.
    """
    spark = df.sparkSession
    terms = lexicon.select(F.col(f"`{term}`").cast("string").alias("term"), F.col(f"`{group}`").cast("string").alias("group"))
    terms = stored(terms.where("term is not null and group is not null").distinct(), "lexicon")
    size = terms.agg(F.sum(F.octet_length("term") + F.octet_length("group"))).first()[0] or 0
    parts = size // PART_BYTES + 1
    kind = MapType(StringType(), LongType())
    base = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != output.lower()))
    result = base.withColumn(output, F.lit(None).cast(kind))
    schema = StructType([*base.schema.fields, StructField(output, kind)])
    place = base.columns.index(text)
    for part in range(parts):
        own = terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(sent.value)
            for batch in batches:
                before = batch.column(batch.num_columns - 1).to_pylist()
                found = []
                for value, earlier in zip(batch.column(place).to_pylist(), before, strict=True):
                    counts = Counter(dict(earlier or ()))
                    counts.update(automaton.count(value))
                    found.append(sorted(counts.items()))
                columns = [*batch.columns[:-1], pa.array(found, pa.map_(pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        result = result.mapInArrow(run, schema)
    return result
