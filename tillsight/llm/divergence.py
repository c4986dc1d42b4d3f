"""Source divergence audit: how far the sources of a language differ in their words.

Single-pass in-memory indexing: a task counts the terms of its documents per language and source until its block holds so many
postings, then passes the block on as a term-sorted run, cut by hash shard. Each shard merges its runs with a heap into the
frequencies of its terms. A last pass streams the frequencies: two sources differ by their smoothed shares of unseen terms,
and only terms that one of them holds are corrected.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillsight.llm.common import pieces, table
from tillsight.plans.shared import stored

#: Documents of a language that a term has to occur in, counts added to every term, and the scale of shares.
LEAST_DOCUMENTS = 30
ADDED = 5
SCALE = 1_000_000_000
TOP = 50
#: Postings (term of a language and source) a task holds before it passes a run on, and postings of one segment of a run.
BLOCK_POSTINGS = 1_500_000
SEGMENT = 8192
#: Postings a merging task holds before it settles the terms that are complete, and hash shards for each partition.
MERGED_POSTINGS = 500_000
SHARDS_EACH = 4
#: Cells (posting by source) corrected at once, and corrections (source by source) held before they are passed on.
CELLS = 1 << 21
HELD = 1 << 22

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Between the language and the term of a key; no term holds it.
_END = b"\x00"

RUNS = "shard int, first binary, keys array<binary>, sources array<string>, totals array<bigint>, docs array<bigint>"
COLUMNS = ["keys", "sources", "totals", "docs"]
FREQUENCIES = "lang string, term string, sources array<string>, totals array<bigint>"


def terms_of(text: bytes | None) -> list[bytes]:
    """Stretches of letters (A-Z lower-cased) and characters beyond ASCII."""
    return text.translate(_LETTERS).split() if text else []


class Block:
    """Counts of terms and of the documents that hold them, by language and source."""

    def __init__(self) -> None:
        self.totals: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def add(self, lang: str, source: str, terms: list[bytes]) -> int:
        """Count a document; returns the postings it added."""
        docs = self.docs[lang, source]
        before = len(docs)
        self.totals[lang, source].update(terms)
        docs.update(set(terms))
        return len(docs) - before

    def runs(self, shards: int) -> Iterator[tuple[int, pa.Table]]:
        """Segments of the block's run of every shard, in the order of keys (language, then term)."""
        keys: list[bytes] = []
        codes: list[int] = []
        totals, docs, groups, sources = [], [], [], []
        for (lang, source), counted in self.docs.items():
            start = lang.encode() + _END
            seed = zlib.crc32(start)
            keys += [start + term for term in counted]
            codes += [zlib.crc32(term, seed) for term in counted]
            own = self.totals[lang, source]
            totals.append(np.fromiter(map(own.__getitem__, counted), np.int64, len(counted)))
            docs.append(np.fromiter(counted.values(), np.int64, len(counted)))
            groups.append(np.full(len(counted), len(sources), np.int32))
            sources.append(source)
        if not keys:
            return
        names = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(groups)), pa.array(sources, pa.string())).cast(pa.string())
        shard = np.array(codes, np.int64) % shards
        columns = [pa.array(keys, pa.binary()), names, pa.array(np.concatenate(totals)), pa.array(np.concatenate(docs))]
        postings = pa.table([pa.array(shard), *columns], names=["shard", *COLUMNS])
        postings = postings.sort_by([("shard", "ascending"), ("keys", "ascending")]).combine_chunks()
        numbers = postings.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:]):
            for start in range(a, b, SEGMENT):
                yield int(numbers[a]), postings.slice(start, min(SEGMENT, b - start)).select(COLUMNS)


def sorted_runs(documents: DataFrame, shards: int) -> DataFrame:
    """Runs of `lang`, `source`, `text` in segments, each with its shard and first key."""

    def rows(block: Block) -> Iterator[pa.RecordBatch]:
        for shard, segment in block.runs(shards):
            lists = []
            for column in segment.columns:
                values = column.combine_chunks()
                lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            first = [pa.array([shard], pa.int32()), segment.column("keys").slice(0, 1).combine_chunks()]
            yield pa.RecordBatch.from_arrays(first + lists, names=["shard", "first", *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = Block(), 0
        for batch in batches:
            for part, texts in pieces(batch, 2):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    held += block.add(lang, source, terms_of(text))
                    if held >= BLOCK_POSTINGS:
                        yield from rows(block)
                        block, held = Block(), 0
        yield from rows(block)

    return documents.select("lang", "source", "text").mapInArrow(run, RUNS)


def merged_runs(segments: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Postings of sorted segments that come in the order of their first keys; all postings of a key come together.

    Segments lie in a heap by the first key they have left. When enough postings are held, those below the first key of the
    segment that comes next are complete: their segments are taken from the heap and cut there.
    """
    heap: list[tuple[bytes, int, pa.Table]] = []
    held = number = 0

    def below(limit: bytes | None) -> Iterator[pa.Table]:
        nonlocal held, number
        parts = []
        while heap and (limit is None or heap[0][0] < limit):
            _, _, segment = heapq.heappop(heap)
            keys = segment.column("keys")
            cut = len(keys) if limit is None else bisect_left(range(len(keys)), limit, key=lambda i: keys[i].as_py())
            parts.append(segment.slice(0, cut))
            held -= cut
            if cut < len(keys):
                heapq.heappush(heap, (keys[cut].as_py(), number, segment.slice(cut)))
                number += 1
        if parts:
            yield pa.concat_tables(parts)

    for segment in segments:
        first = segment.column("keys")[0].as_py()
        if held >= MERGED_POSTINGS:
            yield from below(first)
        heapq.heappush(heap, (first, number, segment))
        number += 1
        held += segment.num_rows
    yield from below(None)


def kept_terms(postings: pa.Table, least: int) -> pa.Table:
    """Occurrences by key and source of the keys that enough documents have."""
    docs = postings.group_by("keys").aggregate([("docs", "sum")])
    kept = docs.filter(pc.greater_equal(docs.column("docs_sum"), least)).column("keys")
    return postings.filter(pc.is_in(postings.column("keys"), kept)).group_by(["keys", "sources"]).aggregate([("totals", "sum")])


def term_frequencies(runs: DataFrame, partitions: int, least: int) -> DataFrame:
    """`lang`, `term`, `sources`, `totals` of the terms that occur in at least `least` documents of the language."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column("shard")[i].as_py(), pa.table([batch.column(name)[i].values for name in COLUMNS], names=COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, segments in groupby(read(batches), key=lambda row: row[0]):
            for postings in merged_runs(segment for _, segment in segments):
                found = kept_terms(postings, least).sort_by([("keys", "ascending"), ("sources", "ascending")]).combine_chunks()
                if found.num_rows:
                    keys = found.column("keys").combine_chunks()
                    starts = np.flatnonzero(np.append(True, pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)))
                    offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
                    names = [key.rpartition(_END) for key in keys.take(pa.array(starts)).to_pylist()]
                    lists = [pa.ListArray.from_arrays(offsets, found.column(c).combine_chunks()) for c in ("sources", "totals_sum")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang.decode() for lang, _, _ in names]), pa.array([term.decode() for _, _, term in names]), *lists],
                        names=["lang", "term", "sources", "totals"],
                    )

    dealt = runs.repartition(partitions, "shard").sortWithinPartitions("shard", "first")
    return dealt.mapInArrow(run, FREQUENCIES)


def shares(counts: np.ndarray, weights: np.ndarray, scale: int) -> np.ndarray:
    """1 + floor(scale * counts / weights) without rounding, in whole numbers of any size where 64 bits do not do."""
    if counts.size and int(counts.max()) > (1 << 62) // scale:
        return np.array(1 + counts.astype(object) * scale // weights.astype(object), np.int64)
    return 1 + counts * scale // weights


class Language:
    """Groups of a language: names in order, the weight of every source and of the language, and shares of unseen terms."""

    def __init__(self, sources: list[str], totals: list[int], terms: int, added: int, scale: int):
        self.sources, self.place = sources, {s: i for i, s in enumerate(sources)}
        own = np.array(totals, np.int64)
        self.weights, self.weight = own + added * terms, np.int64(own.sum() + added * terms)
        self.added, self.scale = added, scale
        self.unseen = shares(np.full(len(own), added, np.int64), self.weights, scale)

    def corrections(self, row: np.ndarray, place: np.ndarray, counts: np.ndarray, rows: int) -> Iterator[tuple[int, np.ndarray]]:
        """For a source, twice what its postings add to its distance from every source beyond that of unseen terms.

        A posting that both sources of a pair have is met from both sides, so it counts once from each.
        """
        step = max(1, CELLS // len(self.sources))
        shares_of = shares(counts + self.added, self.weights[place], self.scale)
        for start in range(0, rows, step):  # terms of a step, as far as their rows reach
            own = (row >= start) & (row < start + step)
            r, p, v = row[own] - start, place[own], shares_of[own]
            there = np.broadcast_to(self.unseen, (min(step, rows - start), len(self.sources))).copy()
            held = np.zeros(there.shape, np.int64)
            there[r, p] = v
            held[r, p] = 1
            order = np.argsort(p, kind="stable")
            for a, here in groupby(order, key=lambda i: p[i]):
                here = np.fromiter(here, np.int64)
                gap = np.abs(v[here][:, None] - there[r[here]]) - np.abs(self.unseen[a] - self.unseen)
                yield int(a), (gap * (2 - held[r[here]])).sum(axis=0)

    def above(self, row: np.ndarray, place: np.ndarray, counts: np.ndarray, rows: int) -> np.ndarray:
        """Share of each posting in its source less the term's share in the language."""
        totals = np.zeros(rows, np.int64)
        np.add.at(totals, row, counts)
        in_language = shares(totals + self.added, np.full(rows, self.weight), self.scale)
        return shares(counts + self.added, self.weights[place], self.scale) - in_language[row]


def best(held: list[tuple[int, str]], top: int) -> list[tuple[int, str]]:
    """The `top` largest values, ties by the smaller term."""
    return heapq.nsmallest(top, held, key=lambda x: (-x[0], x[1]))


def corrected(frequencies: DataFrame, groups: dict[str, tuple[list[str], list[int], int]], added: int, scale: int, top: int) -> DataFrame:
    """Stream of the frequencies: sums of pair corrections (`other` set) and each task's best terms (`item` set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = {lang: Language(*known, added, scale) for lang, known in groups.items()}
        sums: dict[tuple[str, int], np.ndarray] = {}
        terms: dict[tuple[str, int], list[tuple[int, str]]] = defaultdict(list)
        held = 0

        def sum_rows() -> pa.RecordBatch:
            columns = [[], [], [], []]
            for (lang, a), row in sums.items():
                there = np.flatnonzero(row)
                sources = languages[lang].sources
                columns[0] += [lang] * len(there)
                columns[1] += [sources[a]] * len(there)
                columns[2] += [sources[b] for b in there]
                columns[3] += row[there].tolist()
            return out(*columns[:3], [None] * len(columns[0]), columns[3])

        def out(lang, source, other, item, value) -> pa.RecordBatch:
            kinds = [pa.string()] * 4 + [pa.int64()]
            names = ["lang", "source", "other", "item", "value"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((lang, source, other, item, value), kinds, strict=True)], names=names)

        for batch in batches:
            langs, words = batch.column("lang").to_pylist(), batch.column("term").to_pylist()
            sources, totals = batch.column("sources").to_pylist(), batch.column("totals").to_pylist()
            for lang in sorted(set(langs)):
                here, mine = languages[lang], [i for i, x in enumerate(langs) if x == lang]
                sizes = [len(totals[i]) for i in mine]
                row = np.repeat(np.arange(len(mine)), sizes)
                place = np.array([here.place[s] for i in mine for s in sources[i]], np.int64)
                counts = np.array([n for i in mine for n in totals[i]], np.int64)
                for a, more in here.corrections(row, place, counts, len(mine)):
                    if (lang, a) not in sums:
                        sums[lang, a] = np.zeros(len(here.sources), np.int64)
                        held += len(here.sources)
                    sums[lang, a] += more
                    if held >= HELD:
                        yield sum_rows()
                        sums.clear()
                        held = 0
                value = here.above(row, place, counts, len(mine))
                for a in np.unique(place):
                    own = np.flatnonzero((place == a) & (value > 0))
                    if len(own) > top:
                        least = -np.partition(-value[own], top - 1)[top - 1]
                        own = own[value[own] >= least]
                    key = (lang, int(a))
                    terms[key] = best(terms[key] + [(int(value[i]), words[mine[row[i]]]) for i in own], top)
        yield sum_rows()
        for (lang, a), found in terms.items():
            n = len(found)
            yield out([lang] * n, [languages[lang].sources[a]] * n, [None] * n, [t for _, t in found], [v for v, _ in found])

    return frequencies.mapInArrow(run, "lang string, source string, other string, item string, value bigint")


def source_divergence(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST_DOCUMENTS,
    added: int = ADDED,
    scale: int = SCALE,
    top: int = TOP,
) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank`: distances between sources, and the terms a source uses above its language.

    Part `pair` has the distance to every other source of the language, summed over the language's kept terms (0 where it
    keeps none); part `term` the `top` terms whose share in the source exceeds that in the language. A term is kept when at
    least `least` documents of the language have it. Nulls count as empty: an empty language or source is a group like any
    other, a text without terms only makes its group occur. Repeated rows are documents of their own. Values are exact whole
    numbers, ties go by item. Texts are counted whole, whatever their length. Only the named columns are read; an empty
    table gives an empty result. The table of sources is sent to the tasks: it has a row for each source, the result one for
    each pair of them.
    """
    spark = documents.sparkSession
    given = documents.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequencies = stored(term_frequencies(sorted_runs(given, SHARDS_EACH * partitions), partitions, least), "term-frequencies")

    each = frequencies.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("c")).groupBy("lang", F.col("c.sources").alias("source"))
    counted = each.agg(F.sum("c.totals").alias("total"))
    kept = frequencies.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = given.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")), "source-groups")

    known: dict[str, tuple[list[str], list[int], int]] = {}
    for row in groups.where("terms > 0").orderBy("lang", "source").collect():
        names, totals, _ = known.setdefault(row["lang"], ([], [], row["terms"]))
        names.append(row["source"])
        totals.append(row["total"])
    found = stored(corrected(frequencies, known, added, scale, top), "source-corrections")

    unseen = F.when(F.col("terms") > 0, F.expr(f"1 + ({added * scale}L div (total + {added} * terms))"))
    own = groups.select("lang", "source", "terms", unseen.alias("unseen"))
    other = own.select("lang", F.col("source").alias("item"), F.col("unseen").alias("item_unseen"))
    # A pair's corrections come from either side; both halves are added under the pair.
    sums = found.where("other is not null and source <> other").groupBy("lang", F.least("source", "other").alias("low"), F.greatest("source", "other").alias("high"))
    halves = sums.agg(F.expr("sum(value) div 2").alias("more"))
    apart = own.join(other, "lang").where("source <> item").withColumns({"low": F.least("source", "item"), "high": F.greatest("source", "item")})
    pairs = apart.join(halves, ["lang", "low", "high"], "left").select(
        "lang",
        "source",
        F.lit("pair").alias("part"),
        "item",
        F.when(F.col("terms") > 0, F.col("terms") * F.abs(F.col("unseen") - F.col("item_unseen")) + F.coalesce("more", F.lit(0))).otherwise(0).cast("bigint").alias("value"),
    )
    terms = found.where("item is not null").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between sources and their typical terms, over all documents."""
    return source_divergence(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP11_SQL = f"""
with docs as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
    from docs_in
), words as (
    select r, lang, source, unnest(w) as term from docs
), kept as materialized (
    select lang, term from words group by lang, term having count(distinct r) >= {LEAST_DOCUMENTS}
), counts as materialized (
    select lang, source, term, count(*) as c from words semi join kept using (lang, term) group by lang, source, term
), sizes as (
    select lang, count(*) as v from kept group by lang
), groups as materialized (
    select g.lang, g.source, coalesce(v, 0) as v, coalesce(n, 0) as n
    from (select distinct lang, source from docs) g left join sizes using (lang)
    left join (select lang, source, sum(c) as n from counts group by lang, source) using (lang, source)
), shares as materialized (
    select g.lang, g.source, k.term, coalesce(c, 0) as c, 1 + ({SCALE}::hugeint * (coalesce(c, 0) + {ADDED})) // (n + {ADDED} * v) as p
    from groups g join kept k using (lang) left join counts using (lang, source, term)
), whole as (
    select lang, term, 1 + ({SCALE}::hugeint * (sum(s.c) + {ADDED})) // (any_value(t.n) + {ADDED} * any_value(t.v)) as q
    from shares s join (select lang, sum(n) as n, any_value(v) as v from groups group by lang) t using (lang) group by lang, term
), apart as (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
), terms as (
    select lang, source, 'term' as part, term as item, p - q as value from shares join whole using (lang, term) where c > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
    from (select * from pairs union all select * from terms)
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked
where part = 'pair' or rank <= {TOP}
""".replace("docs_in", "documents")
