import hashlib
import math
import random

import pytest

from tillsight.llm import centroids

KIND = "vec_id bigint, embedding array<float>, label int"


def plain(rows, clusters, rounds, components, scale=64, seed=1):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centres = [v for _, v in sorted(named)[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))[::-1] for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(centres)):
            own = [v for (_, v), (c, _) in zip(kept, found) if c == k]
            if own:
                centres[k] = [sum(column) // len(own) for column in zip(*own)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    found = assign()
    sums = {k: sum(d for c, d in found if c == k) for k in range(len(centres))}
    total = sum(sums.values())
    return sorted(((i, c, d, sums[c], total, digests[c]) for (i, _), (c, d) in zip(kept, found)), key=repr)


def run(spark, rows, components=64, parts=3, **how):
    vectors = spark.createDataFrame(rows, KIND).repartition(parts)
    found = centroids.with_figures(centroids.cluster_vectors(vectors, components=components, **how))
    return sorted((tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(n, components, spread=2.0, seed=3):
    draw = random.Random(seed)
    # Multiples of 1/128, so that floats hold them and many floors are inexact.
    return [(k, [round(draw.uniform(-spread, spread) * 128) / 128 for _ in range(components)], k % 3) for k in range(n)]


@pytest.mark.parametrize("width,chunk", [(16, 4096), (7, 10), (64, 3), (100, 50)])
def test_against_plain_rounds(spark, monkeypatch, width, chunk):
    monkeypatch.setattr(centroids, "CHUNK_ROWS", chunk)
    rows = vectors(90, 20)
    assert run(spark, rows, 20, clusters=6, rounds=3, width=width) == plain(rows, 6, 3, 20)


def test_wide_numbers_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BUCKET_SLICES", 1)
    monkeypatch.setattr(centroids, "CHUNK_ROWS", 5)
    rows = vectors(60, 6, spread=40_000.0)
    assert run(spark, rows, 6, clusters=4, rounds=2, width=2) == plain(rows, 4, 2, 6)


def test_odd_rows_ties_and_repeats(spark):
    rows = [
        (1, [0.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [1.0, 1.0], 1), (3, [1.0, 1.0], 1), (3, [-1.0, 0.5], 1),
        (None, [0.5, 0.5], 1), (None, [0.5, 0.5], None), (7, None, 1), (8, [], 1), (9, [1.0], 1), (10, [1.0, 2.0, 3.0], 1),
        (11, [None, 1.0], 1), (12, [float("nan"), 1.0], 1), (13, [float("inf"), 1.0], 1), (14, [0.0, 0.0], 2),
    ]
    for clusters in (1, 3, 16):
        assert run(spark, rows, 2, clusters=clusters, width=1) == plain(rows, clusters, 3, 2)


def test_all_rows_equal(spark):
    rows = [(k, [0.25] * 4, 0) for k in range(50)]
    found = run(spark, rows, 4, clusters=5)
    assert found == plain(rows, 5, 3, 4) and {r[1] for r in found} == {0}


def test_partitions_do_not_matter(spark):
    rows = vectors(200, 64)
    assert run(spark, rows, parts=1) == run(spark, rows, parts=7) == plain(rows, 16, 3, 64)


def test_nothing_to_cluster(spark):
    assert run(spark, [], parts=1) == []
    assert run(spark, [(1, None, 1), (2, [1.0], 1)]) == []


def test_only_null_ids_have_no_first_centroid(spark):
    with pytest.raises(ValueError, match="no vector has an id"):
        run(spark, [(None, [1.0, 2.0], 0)], 2)


def test_too_large_components_fail(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e30, 0.0], 0), (2, [0.0, 0.0], 0)], 2)


def test_clashing_names(spark):
    rows = [(k, [float(k % 3), 1.0], k) for k in range(9)]
    odd = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr(
        "vec_id as block", "embedding as chunk", "label as cluster", "7 as distance", "'x' as id"
    )
    found = centroids.cluster_vectors(odd, 3, components=2, vec_id="block", vector="chunk").assigned
    assert found.columns == ["block", "cluster", "distance"] and found.count() == 9
