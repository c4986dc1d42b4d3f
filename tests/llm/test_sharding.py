import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tillsight.llm import sharding


def plain(rows, shards):
    """Id, size, checksum and shard of every row, in the order of keys; copies follow each other."""

    def key(row):
        return hashlib.md5(f"{'' if row[0] is None else row[0]}:{row[1] or ''}".encode()).hexdigest()

    def size(row):
        return len((row[1] or "").encode()) + 16

    total, below, found = sum(map(size, rows)), 0, []
    for row in sorted(rows, key=key):
        found.append((row[0], size(row), zlib.crc32((row[1] or "").encode()), below * shards // total))
        below += size(row)
    return sorted(found, key=repr)


def check(spark, rows, shards=40, tolerance=0):
    found = sharding.into_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), shards, tolerance=tolerance).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if not tolerance:
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in found), key=repr) == plain(rows, shards)
    return found


@pytest.mark.parametrize("runs", [4096, 20])
def test_against_plain_sums(spark, monkeypatch, runs):
    monkeypatch.setattr(sharding, "RUN_ROWS", runs)
    draw = random.Random(1)
    rows = [(k, "é" * draw.randint(0, 50) if draw.random() < 0.7 else "the same text of many rows") for k in range(700)]
    rows += [(None, None), (None, "x"), (3, rows[3][1]), (3, rows[3][1]), (800, "y" * 20_000), (801, None), (802, "")]
    check(spark, rows)
    check(spark, rows, shards=3)
    check(spark, rows, shards=1)


def test_borders_need_more_digits(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DIGITS", 1)
    draw = random.Random(2)
    check(spark, [(k, "z" * draw.randint(0, 9)) for k in range(300)])


def test_tolerance_is_met(spark):
    rows = [(k, "t" * (k % 50)) for k in range(4000)]
    total, tolerance = sum(k % 50 + 16 for k in range(4000)), 500
    found = check(spark, rows, 8, tolerance)
    sums = defaultdict(int)
    for r in found:
        sums[r["shard"]] += r["size"]
    below = 0
    for k in range(7):
        below += sums[k]
        assert abs(below - (k + 1) * total / 8) <= tolerance + 66


@pytest.mark.parametrize("runs", [4096, 100])
def test_repeated_rows_are_spread(spark, monkeypatch, runs):
    """A third of the rows are one row: every shard is used, and their bytes differ by a row at most."""
    monkeypatch.setattr(sharding, "RUN_ROWS", runs)
    text = "the same row " * 10
    rows = [(k, "w" * (k % 200)) for k in range(6000)] + [(None, text)] * 3000 + [(7, "twice")] * 2 + [(8, None)] * 150
    found = check(spark, rows)
    sums = defaultdict(int)
    for r in found:
        sums[r["shard"]] += r["size"]
    assert len(sums) == 40 and max(sums.values()) - min(sums.values()) <= 2 * max(len(text) + 16, 216)


def test_slots_follow_the_order_of_keys(spark, monkeypatch):
    """Hot keys in one run with others, below and above them."""
    monkeypatch.setattr(sharding, "RUN_ROWS", 5)
    monkeypatch.setattr(sharding, "_run_digits", lambda rows: 1)
    rows = [(k, "x") for k in range(40)] + [(100, "a")] * 20 + [(101, "b")] * 30 + [(102, "c")] * 7
    found = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    slots = sorted((r["shard"], r["slot"], hashlib.md5(f"{r['doc_id']}:{r['text']}".encode()).hexdigest()) for r in sharding.into_shards(found, 3).collect())
    assert [k for *_, k in slots] == sorted(k for *_, k in slots)


def test_edges(edge, nothing):
    found = sharding.into_shards(edge)
    assert found.columns.count("shard") == 1 and "row" in found.columns and found.count() == 11
    assert sharding.into_shards(nothing).count() == 0
