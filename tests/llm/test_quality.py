import itertools

import numpy as np
import pytest

from tillsight.llm import quality
from tillsight.llm.common import crc_fold

DATA = "/root/testdata/sf0.01"


def test_marginals_are_sums_over_all_labellings():
    draw = np.random.default_rng(1)
    chain = quality.LineChain(np.zeros(1), draw.normal(size=(2, 2)), np.zeros(0), np.ones(0))
    lengths = np.array([3, 1, 5, 1, 4])
    unary = draw.normal(size=lengths.sum()) * 2
    good, pairs = chain.marginals(unary, lengths, with_pairs=True)
    assert np.allclose(good, chain.marginals(unary, lengths))
    wanted_pairs, start = np.zeros((2, 2)), 0
    for n in lengths:
        own = unary[start : start + n]
        total, marks, counts = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(u for u, y in zip(own, labels) if y) + sum(chain.pairs[a, b] for a, b in zip(labels, labels[1:])))
            total += weight
            marks += weight * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                counts[a, b] += weight
        assert np.allclose(good[start : start + n], marks / total)
        wanted_pairs += counts / total
        start += n
    assert np.allclose(pairs, wanted_pairs)


def test_score_does_not_depend_on_the_batch():
    draw = np.random.default_rng(2)
    width = quality.OWN + 2 * (quality.BESIDE + 1)
    model = quality.LineChain(draw.normal(size=width + 1), draw.normal(size=(2, 2)), np.zeros(width), np.ones(width))
    texts = [b"One line.\nTwo lines here.", None, b"", b"  \n ", b"x", b"A\n\nB\n" * 50]
    together = model.scores(texts)
    assert together == pytest.approx([model.scores([t])[0] for t in texts])
    assert together[1] == together[2] == together[3] == 0 and all(0 <= s <= 1 for s in together)


def test_without_labels_of_both_kinds():
    assert quality.fit([]).scores([b"some text"]) == [0.5]
    one = [(quality.text_features(b"a b\nc")[0], 1)]
    assert quality.fit(one).scores([b"some text"])[0] > 0.9
    assert quality.fit([(f, 0) for f, _ in one]).scores([b"some text"])[0] < 0.1


def test_held_out_accuracy(spark):
    found = {r["doc_id"]: r for r in quality.op4_quality(spark, DATA).collect()}
    assert len(found) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [r for r in found.values() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (crc_fold(i, 3) == 1) for i, r in found.items())
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.97


def test_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1, 7), (9, 0, 7), (5, None, 7), (None, 0, 7), (3, 0, 7), (1, 1, 7)], "doc_id bigint, quality int, text int")
    model = quality.train(edge, labels)
    rows = quality.with_quality(edge.withColumnRenamed("score", "quality_score"), model).collect()
    assert len(rows) == 11
    for r in rows:
        assert 0 <= r["quality_score"] <= 1
        assert (r["quality_score"] == 0) == (not (r["text"] or "").strip())
    assert quality.with_quality(nothing, quality.train(nothing, labels.limit(0))).count() == 0


def test_sample_is_bounded_in_rows_and_lines(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda documents: fitted.append(documents))
    rows = [(1, f"Copy number {k}.\nA second line.") for k in range(30)] + [(1, None), (1, " \n")]
    rows += [(k, f"Document {k}.\nA second line.\nA third one.") for k in range(2, 12)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 12)], "doc_id bigint, quality int")
    quality.train(documents, labels, held_out=(1, 1))
    quality.train(documents, labels, held_out=(1, 1), total_lines=10)
    quality.train(documents, labels, held_out=(1, 1), total_lines=1)
    sizes = [[len(features) for features, _ in found] for found in fitted]
    assert sorted(sizes[0]) == [2] + [3] * 10
    assert 7 < sum(sizes[1]) <= 10 and sizes[2] == []
    # A document of very many lines is learnt from if the total holds it, and does not keep out the others if not.
    long = documents.union(spark.createDataFrame([(12, "One line of many.\n" * 5000)], "doc_id bigint, text string"))
    more = labels.union(spark.createDataFrame([(12, 1)], "doc_id bigint, quality int"))
    for total in (400_000, 40):
        quality.train(long, more, held_out=(1, 1), total_lines=total)
    sizes = [sorted(len(features) for features, _ in found) for found in fitted[3:]]
    assert sizes[0] == [2] + [3] * 10 + [5001] and sizes[1] == [2] + [3] * 10
