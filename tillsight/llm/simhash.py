"""Near-duplicate documents by fingerprints of word shingles.

Fingerprints with few differing bits are found by a self-join of a binary trie: pairs of nodes are followed down
together, the bits in which their paths differ are added up, and a pair is dropped as soon as they exceed the
budget. Two fingerprints within the budget of k bits agree in at least one of k + 1 blocks of bits, so the
tries of one block value each hold every link and can be searched in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm.common import map_texts, sent_if_small, table
from tillsight.llm.graph import Forest, connected_components
from tillsight.plans.shared import stored

SHINGLE_WORDS = 3
MOST_BITS = 3
SEED = 42
#: Fingerprints of one trie; the tries of a block value with more are split into pairs of parts.
TRIE_FINGERPRINTS = 200_000
#: Node pairs followed at once, shingles hashed at once, and the size of a node pair that is compared directly.
PAIRS_AT_ONCE = 400_000
SHINGLES_AT_ONCE = 1 << 16
DIRECT = 24

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint: a bit is set if it is set in over half of the shingle hashes; no words give zero."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(ends), SHINGLES_AT_ONCE):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[k : k + SHINGLES_AT_ONCE], ends[k : k + SHINGLES_AT_ONCE])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def with_fingerprints(documents: DataFrame, text: str = "text", size: int = SHINGLE_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Add `fingerprint_bits` (the 64 bits as a signed number) to every row; null and empty texts get zero."""

    def make():
        def compute(texts):
            found = [fingerprint(value, size) for value in texts]
            return [[f - (1 << 64) if f >> 63 else f for f in found]]

        return compute

    return map_texts(documents, text, "fingerprint_bits bigint", make, keep)


def trie_pairs(prints: np.ndarray, first: np.ndarray, last: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within `most` differing bits among the sorted, distinct fingerprints of each trie.

    Trie t holds positions first[t] to last[t]. A node is the range of positions that share the bits so far.
    """
    ones: dict[int, np.ndarray] = {}

    def split(low, high, depth):
        if depth not in ones:
            bit = (prints >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
        return high - (ones[depth][high] - ones[depth][low])

    zero = np.zeros(len(first), np.int64)
    stack = [(0, np.stack([first, last, first, last, zero]))]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > PAIRS_AT_ONCE:
            stack.append((depth, pairs[:, PAIRS_AT_ONCE:]))
            pairs = pairs[:, :PAIRS_AT_ONCE]
        a, b = pairs[1] - pairs[0], pairs[3] - pairs[2]
        own = pairs[0] == pairs[2]
        pairs = pairs[:, ~(own & (a == 1))]
        a, b = pairs[1] - pairs[0], pairs[3] - pairs[2]
        direct = (a * b <= DIRECT) if depth < 64 else np.ones(len(a), bool)
        if direct.any():
            here = pairs[:, direct]
            cells = a[direct] * b[direct]
            which = np.repeat(np.arange(len(cells)), cells)
            cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
            x = here[0][which] + cell // b[direct][which]
            y = here[2][which] + cell % b[direct][which]
            near = (x < y) | (here[0][which] != here[2][which])
            near &= np.bitwise_count(prints[x] ^ prints[y]) <= most
            if near.any():
                yield x[near], y[near]
            pairs = pairs[:, ~direct]
        if not pairs.shape[1]:
            continue
        al, ah, bl, bh, bits = pairs
        am, bm = split(al, ah, depth), split(bl, bh, depth)
        apart = al != bl
        children = np.concatenate(
            [
                np.stack([al, am, bl, bm, bits]),
                np.stack([am, ah, bm, bh, bits]),
                np.stack([al, am, bm, bh, bits + 1]),
                np.stack([am, ah, bl, bm, bits + 1])[:, apart],
            ],
            axis=1,
        )
        there = (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= most)
        if there.any():
            stack.append((depth + 1, children[:, there]))


def _links_of(tries: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of each trie as its pairs do, one per fingerprint at most."""
    starts = np.flatnonzero(np.concatenate(([True], tries[1:] != tries[:-1])))
    ends = np.append(starts[1:], len(tries))
    forest = Forest(len(prints))
    for x, y in trie_pairs(prints, starts, ends, most):
        forest.join(x, y)
    root = forest.roots()
    linked = np.flatnonzero(root != np.arange(len(root)))
    return prints[linked].view(np.int64), prints[root[linked]].view(np.int64)


def fingerprint_links(prints: DataFrame, most: int = MOST_BITS, trie_size: int = TRIE_FINGERPRINTS) -> DataFrame:
    """Links `a`, `b` that connect distinct `fingerprint_bits` as all pairs within `most` bits do."""
    blocks = most + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    f = F.col("fingerprint_bits")
    keys = F.array(
        *(
            F.struct(
                F.lit(k).alias("block"),
                F.shiftrightunsigned(F.shiftleft(f, 64 - edges[k + 1]), 64 - edges[k + 1] + edges[k]).alias("bits"),
            )
            for k in range(blocks)
        )
    )
    placed = prints.select(f, F.explode(keys).alias("key")).select("key.*", f)
    crowded = (
        placed.groupBy("block", "bits").count().where(F.col("count") > trie_size)
        .select("block", "bits", F.ceil(F.col("count") / trie_size * 2).cast("int").alias("parts"))
    )
    crowded = stored(crowded, "crowded-tries")
    part = F.pmod(F.xxhash64(f), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(part, k).alias("i"), F.greatest(part, k).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    tries = (
        placed.join(crowded, ["block", "bits"], "left")
        .withColumn("pair", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(others)))
        .select(F.xxhash64("block", "bits", "pair.i", "pair.j").alias("trie"), f)
    )
    sign = F.lit(-(1 << 63)).cast("bigint")
    arranged = tries.repartition("trie").sortWithinPartitions("trie", f.bitwiseXOR(sign))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []  # rows of a trie that may go on in the next batch
        for batch in batches:
            rows = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)])
            if rest and rows[0][-1] == rest[0][0][0]:
                rest.append(rows)
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from found([*rest, rows[:, :cut]])
            rest = [rows[:, cut:]]
        yield from found(rest)

    def found(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sum(p.shape[1] for p in parts):
            rows = np.concatenate(parts, axis=1)
            prints = np.ascontiguousarray(rows[1]).view(np.uint64)
            fresh = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (prints[1:] != prints[:-1])))
            a, b = _links_of(rows[0][fresh], prints[fresh], most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return arranged.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE_WORDS,
    most: int = MOST_BITS,
    trie_size: int = TRIE_FINGERPRINTS,
) -> DataFrame:
    """`doc_id`, `fingerprint_bits` and `component_id` of every row.

    The component is the smallest id reachable over links of at most `most` differing bits. Null and empty texts
    and texts of white space have fingerprint zero and are linked like others. A null id is kept but never names a
    component; a component of null ids only has none. Repeated rows and ids are rows of one component. Only the
    two columns named are read, so others cannot clash; an empty table gives an empty result.
    """
    return _grouped(documents, doc_id, text, size, most, trie_size).select("doc_id", "fingerprint_bits", "component_id")


def _grouped(documents: DataFrame, doc_id: str, text: str, size: int, most: int, trie_size: int) -> DataFrame:
    """`doc_id`, `row` (hash of the text), `fingerprint_bits`, `group` (its smallest fingerprint) and `component_id`."""
    value = F.col(f"`{text}`")
    narrow = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(value).alias("row"), value.alias("text"))
    prints = stored(with_fingerprints(narrow, "text", size, ["doc_id", "row"]), "fingerprints")
    least = stored(prints.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("least_id")), "fingerprint-groups")
    nodes = connected_components(fingerprint_links(least.select("fingerprint_bits"), most, trie_size), "a", "b")
    nodes = stored(nodes.select(F.col("node").alias("fingerprint_bits"), "component"), "fingerprint-components")
    joined = nodes.join(least, "fingerprint_bits").groupBy("component").agg(F.min("least_id").alias("joined_id"))
    smallest = nodes.join(joined, "component")
    groups = least.join(smallest, "fingerprint_bits", "left").select(
        "fingerprint_bits",
        F.coalesce("component", "fingerprint_bits").alias("group"),
        F.coalesce("joined_id", "least_id").alias("component_id"),
    )
    return prints.join(groups, "fingerprint_bits")


def keep_one(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE_WORDS,
    most: int = MOST_BITS,
    trie_size: int = TRIE_FINGERPRINTS,
) -> DataFrame:
    """The rows of `documents` that stay when each group of near duplicates keeps one: its smallest id.

    Null ids come last. Of several rows with the id the one with the smallest text hash stays, of rows equal in
    both one. Columns and texts are unchanged.
    """
    found = _grouped(documents, doc_id, text, size, most, trie_size)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    copies = found.groupBy("group", "doc_id", "row").count()
    kept = copies.groupBy("group").agg(F.min_by(F.struct("doc_id", "row", "count"), order).alias("first"))
    kept = stored(kept.select(F.col("first.doc_id").alias("__llm_id"), F.col("first.row").alias("__llm_row"), F.col("first.count").alias("copies")), "kept-rows")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__llm_id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__llm_row"))
    rows = documents.join(sent_if_small(kept), same, "left_semi")
    return rows.dropDuplicates([doc_id, text]) if kept.where("copies > 1").limit(1).count() else rows


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    bits = F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0"))
    return found.select("doc_id", bits.alias("fingerprint"), "component_id")
