"""Benchmark decontamination by multi-pattern search over words.

The windows of the benchmark are the patterns, words are the symbols. For all windows of one length a shift
table says, for the block of words that ends at a position, how far the search may move on without passing
an occurrence; where it may not move, the windows of the bucket that ends in this block are compared word by word.
Tables and buckets are flat arrays over the numbers of the benchmark's words, built once in a worker.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm.common import map_texts, table
from tillsight.plans.shared import stored

WINDOW_WORDS = 13
BLOCK_WORDS = 2
#: Benchmark text searched in one pass; a larger benchmark is searched in several passes.
PASS_BYTES = 32 << 20
#: A document is contaminated when at least one word in so many is hit.
HIT_SHARE = 20

_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

RESULTS = "n_words bigint, n_hit bigint, hit_spans array<struct<first:bigint,last:bigint>>, hit_items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, letters a-z and characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WindowSearch:
    """Shift tables and buckets for the windows of one length, as flat arrays over the benchmark's word numbers.

    Equal windows are one: `first` says where one of them starts, and `owners` which items have it. They are sorted by the
    block they end in, so a bucket is a stretch of them.
    """

    def __init__(self, length: int, flat: np.ndarray, starts: np.ndarray, items: np.ndarray, block: int):
        self.length = length
        self.block = block = min(block, length)
        self.furthest = min(length - block + 1, 127)
        self.flat = flat
        # The hashed block that ends at every word of the benchmark; only those within a window are used.
        codes = block_codes(flat, block)
        self.mask = (1 << max(10, int(len(starts) * 2).bit_length())) - 1
        self.shift = np.full(self.mask + 1, self.furthest, np.int8)
        for end in range(block - 1, length):
            np.minimum.at(self.shift, codes[starts + end] & self.mask, np.int8(min(length - 1 - end, self.furthest)))
        groups = same_windows(flat, starts, length)
        order = np.lexsort((groups, codes[starts + length - 1]))
        ends, groups, items, starts = codes[starts + length - 1][order], groups[order], items[order], starts[order]
        fresh = np.append(True, (ends[1:] != ends[:-1]) | (groups[1:] != groups[:-1])) if len(starts) else np.zeros(0, bool)
        own = np.flatnonzero(fresh)
        self.first, self.ends = starts[own], ends[own]
        self.owners, self.owned = items, np.append(own, len(starts))

    def find(self, words: np.ndarray) -> Iterable[tuple[int, np.ndarray]]:
        """First word and items of every occurrence, in the order of the text; unknown words are negative."""
        length, total = self.length, len(words)
        if total < length:
            return
        codes = block_codes(words, self.block)
        shifts = np.where(block_known(words, self.block), self.shift[codes & self.mask], np.int8(self.furthest)).tolist()
        end = length - 1
        while end < total:
            step = shifts[end]
            if step:
                end += step
                continue
            start = end - length + 1
            here = words[start : end + 1]
            for k in range(np.searchsorted(self.ends, codes[end]), np.searchsorted(self.ends, codes[end], "right")):
                at = self.first[k]
                if np.array_equal(self.flat[at : at + length], here):
                    yield start, self.owners[self.owned[k] : self.owned[k + 1]]
            end += 1


_MIX = np.uint64(0x9E3779B97F4A7C15)


def block_codes(words: np.ndarray, block: int) -> np.ndarray:
    """A hash of the last `block` words at every place (of fewer at the start)."""
    numbers = words.astype(np.uint64) + np.uint64(1)
    codes = np.zeros(len(words), np.uint64)
    for k in range(block - 1, -1, -1):
        codes[k:] = (codes[k:] ^ numbers[: len(numbers) - k]) * _MIX
        codes[k:] ^= codes[k:] >> np.uint64(29)
    return codes


def block_known(words: np.ndarray, block: int) -> np.ndarray:
    """Whether all of the last `block` words are words of the benchmark."""
    known = words >= 0
    result = known.copy()
    for k in range(1, block):
        result[k:] &= known[: len(known) - k]
        result[:k] = False
    return result


def same_windows(flat: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """One number for equal windows, told apart word by word: windows that agree in their first words get those of the next."""
    groups = np.zeros(len(starts), np.int64)
    for k in range(length):
        _, groups = np.unique(groups * (len(flat) + 1) + flat[starts + k], return_inverse=True)
    return groups


@dataclass
class Searches:
    """The searches of a benchmark, with the numbers of its words and its items."""

    numbers: dict[bytes, int]
    items: list[str | None]
    lengths: list[WindowSearch]

    def numbered(self, words: list[bytes]) -> np.ndarray:
        get = self.numbers.get
        return np.array([get(w, -1) for w in words], np.int64)


def build_searches(items: Iterable[tuple[str | None, bytes | None]], size: int, block: int) -> Searches:
    numbers: dict[bytes, int] = {}
    texts, names, starts, owners = [], [], defaultdict(list), defaultdict(list)
    total = 0
    for item, text in items:
        words = words_of(text)
        if words:
            texts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
            length, count = min(size, len(words)), max(1, len(words) - size + 1)
            starts[length].append(np.arange(total, total + count))
            owners[length].append(np.full(count, len(names)))
            names.append(item)
            total += len(words)
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    lengths = [WindowSearch(n, flat, np.concatenate(starts[n]), np.concatenate(owners[n]), block) for n in sorted(starts)]
    return Searches(numbers, names, lengths)


_BUILT: dict[str, Searches] = {}


def kept_searches(name: str, rows: list[tuple[str | None, bytes | None]], size: int, block: int) -> Searches:
    """The searches of a pass, built once in a worker and kept for its next tasks."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build_searches(rows, size, block)
    return _BUILT[name]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans (first and last word) that cover the same words, in order."""
    merged: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            if last > merged[-1][1]:
                merged[-1] = (merged[-1][0], last)
        else:
            merged.append((first, last))
    return merged


def search(words: list[bytes], searches: Searches) -> tuple[list[tuple[int, int]], set]:
    spans: list[tuple[int, int]] = []
    found: set = set()
    numbers = searches.numbered(words)
    for one in searches.lengths:
        for start, items in one.find(numbers):
            last = start + one.length - 1
            if spans and spans[-1][1] + 1 >= start >= spans[-1][0]:
                spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
            else:
                spans.append((start, last))
            found.update(items.tolist())
    return merge_spans(spans), {searches.items[i] for i in found}


def _passes(benchmark: DataFrame, item_id: str, text: str, pass_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("binary").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-size // pass_bytes)
    part = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, count)))
    return [items.where(part == k) if count > 1 else items for k in range(count)]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    block: int = BLOCK_WORDS,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Every document row with the words hit by benchmark windows.

    Adds `n_words`, `n_hit`, `hit_spans` (disjoint, first and last word) and `hit_items` (sorted ids as strings).
    An item of fewer words than a window is one window; an item without words, or a null text, has none.
    Windows of an item without id hit words but add no item. Null and empty documents have no words. Repeated
    rows and ids are searched one by one, very long texts as a whole; an empty benchmark hits nothing. Other columns stay; those named
    like a result are replaced. The benchmark reaches the tasks in passes of at most about `pass_bytes`, so
    what a task holds does not grow with it; between passes the rows go to the shared folder.
    """
    spark = documents.sparkSession
    found = documents
    passes = _passes(benchmark, item_id, item_text, pass_bytes)
    for number, part in enumerate(passes or [None]):
        rows = [] if part is None else [(r["item"], r["text"] and bytes(r["text"])) for r in part.toLocalIterator()]
        shared, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def make(shared=shared, name=name):
            searches = kept_searches(name, shared.value, window, block)

            def compute(texts):
                out: list[list] = [[], [], [], []]
                for value in texts:
                    words = words_of(value)
                    spans, items = search(words, searches) if len(words) else ([], set())
                    out[0].append(len(words))
                    out[1].append(sum(last - first + 1 for first, last in spans))
                    out[2].append([{"first": a, "last": b} for a, b in spans])
                    out[3].append(sorted(items - {None}))
                return out

            return compute

        if number == 0:
            found = map_texts(found, text, RESULTS, make)
        else:
            found = _merged(stored(found, "contamination"), text, make)
    return found


def _merged(found: DataFrame, text: str, make) -> DataFrame:
    """Add the hits of one more pass."""
    earlier = {"hit_spans": "__llm_spans", "hit_items": "__llm_items"}
    more = map_texts(found.withColumnsRenamed(earlier), text, RESULTS, make)
    ordered = F.array_sort(F.concat("__llm_spans", "hit_spans"))
    # Spans that touch or overlap become one, as within a pass.
    joined = F.aggregate(
        ordered,
        F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["first"] <= F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["last"] + 1),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["first"].alias("first"),
                        F.greatest(F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["last"], s["last"]).alias("last"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    more = more.withColumn("hit_spans", joined).withColumn("hit_items", F.array_sort(F.array_union("__llm_items", "hit_items")))
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    return more.withColumn("n_hit", hit).drop("__llm_spans", "__llm_items")


def contaminated(n_words="n_words", n_hit="n_hit"):
    return (F.col(n_hit) > 0) & (F.col(n_hit) * HIT_SHARE >= F.col(n_words))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document, as digests."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(documents, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
with item_words as (
    select cast(item_id as varchar) as item,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), windows as (
    select distinct item, least(len(w), 13) as size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as win
    from (select item, w, unnest(range(1, greatest(len(w) - 11, 2))) as i from item_words where len(w) > 0)
), doc_words as (
    select row_number() over () as r, doc_id,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
    from documents
), places as (
    select r, i, size, array_to_string(w[i:i + size - 1], ' ') as win
    from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i
        from doc_words, (select distinct size from windows) where len(w) >= size)
), hits as (
    select p.r, p.i, p.size, w.item from places p join windows w on p.win = w.win and p.size = w.size
), covered as (
    select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + size)) as k from (select distinct r, i, size from hits))
    group by r
), found as (
    select r, count(item) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct r, item from hits where item is not null) group by r
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit,
    cast(coalesce(f.n_items, 0) as bigint) as n_items, sha256(coalesce(f.items, '')) as items_sha256,
    coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from doc_words d left join covered c on d.r = c.r left join found f on d.r = f.r
"""
