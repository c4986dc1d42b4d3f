import math

import numpy as np
import pytest

from tillsight.llm import embeddings
from tillsight.llm.graph import Forest


def plain(rows, least=0.93):
    def good(label, v):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    forest, links = Forest(len(rows)), [0] * len(rows)
    for i, (_, label, v) in enumerate(rows):
        for j, (_, other, w) in enumerate(rows):
            if i != j and label == other and good(label, v) and good(other, w) and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    forest.join(np.array([i]), np.array([j]))
    least_id = {}
    for root, (i, *_) in zip(forest.roots(), rows):
        if i is not None:
            least_id[root] = min(i, least_id.get(root, i))
    return [(i, n, least_id.get(root)) for (i, *_), n, root in zip(rows, links, forest.roots())]


def clustered(draw, count, width, labels):
    centres = draw.normal(size=(6, width))
    return [
        (k, int(draw.integers(0, labels)), (centres[draw.integers(0, 6)] + draw.normal(size=width) * draw.choice([0.05, 0.3, 2])).astype(np.float32).tolist())
        for k in range(count)
    ]


@pytest.mark.parametrize("tile", [512, 20])
def test_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "LEAST_TILE", tile)
    monkeypatch.setattr(embeddings, "MOST_TILE", tile)
    rows = clustered(np.random.default_rng(tile), 150, 24, 2)
    rows += [(500 + k, label, v) for k, (_, label, v) in enumerate(rows[:30])]  # copies
    rows += [(600 + k, label, [x * 3 for x in v]) for k, (_, label, v) in enumerate(rows[:10])]  # scaled
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id int, label int, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == sorted(plain(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_bounds_lose_no_pair():
    draw = np.random.default_rng(9)
    vectors = embeddings._unit(np.array([v for *_, v in clustered(draw, 300, 40, 1)]))
    axes = np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1]
    found = {(int(a), int(b)) for p, q in embeddings.near_pairs(vectors, vectors, axes, 0.93) for a, b in zip(p, q)}
    a, b = np.nonzero(np.einsum("ik,jk->ij", vectors, vectors) >= 0.93)
    assert found == set(zip(a.tolist(), b.tolist()))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (2, 0, [1.0, 0.1]), (3, None, [1.0, 0.0]), (4, 0, None), (5, 0, []), (6, 0, [0.0, 0.0]),
        (7, 0, [nan, 1.0]), (8, 0, [1.0, inf]), (9, 0, [1.0, None]), (10, 0, [1.0, 0.0, 0.0]), (11, 1, [1.0, 0.0]), (None, 1, [1.0, 0.0]),
        (None, 2, [1.0, 0.0]), (12, 0, [1e-30, 0.0]), (13, 0, [-1.0, 0.0]), (None, None, None),
    ]
    table = spark.createDataFrame(rows, "vec_id int, label int, embedding array<float>").selectExpr("*", "1 as rep", "2 as copies", "3 as tile")
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(table).collect()), key=repr)
    assert found == sorted(plain(rows), key=repr)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0
