from collections import Counter, defaultdict

import numpy as np
import pytest

from tillsight.llm import scoring
from tillsight.llm.common import crc_fold

DATA = "/root/testdata/sf0.01"


def plain_counts(rows):
    tokens = [scoring.tokens_of(t and t.encode()) for _, t in rows]
    counts = Counter(t for (i, _), own in zip(rows, tokens) if crc_fold(i, 7) not in (None, 2) for t in own)
    return tokens, counts


def plain(rows):
    tokens, counts = plain_counts(rows)
    n, v = sum(counts.values()), len(counts)
    return {
        (i, t): (len(own), sum(counts[x] > 0 for x in own), n, sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in own))
        for (i, t), own in zip(rows, tokens)
    }


def check(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    found = scoring.score_documents(frame.selectExpr("*", "1 as row", "2 as count", "3 as piece", "4 as held", "5 as hash"))
    wanted = plain(rows)
    result = found.collect()
    assert len(result) == len(rows)
    for r in result:
        options = [w for (i, _), w in wanted.items() if i == r["doc_id"] and w[0] == r["n_tokens"]]
        assert any((r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["base_score"] == pytest.approx(w[3]) for w in options)
        assert r["held_out"] == (crc_fold(r["doc_id"], 7) == 2) and r["score"] <= 1e-6
    return result


@pytest.mark.parametrize("piece", [8 << 20, 300, 1])
def test_against_plain_counts(spark, monkeypatch, piece):
    monkeypatch.setattr(scoring, "PIECE", piece)
    draw = np.random.default_rng(1)
    words = [f"W{k}" for k in range(2_000)]
    rows = [(k, " ".join(words[int(draw.zipf(1.3)) % 2_000] for _ in range(int(draw.integers(0, 60)))) + " \t") for k in range(80)]
    check(spark, rows + [(200, None), (201, ""), (None, "W1 W2"), (5, rows[5][1])])


def test_edges(spark, edge, nothing):
    check(spark, [(r["doc_id"], r["text"]) for r in edge.collect()])
    assert scoring.score_documents(nothing).count() == 0
    held = next(k for k in range(100) if crc_fold(k, 7) == 2)
    only = check(spark, [(held, "no training rows")])
    assert only[0]["train_tokens"] == 0 and only[0]["n_known"] == 0


def small_classes(counts, least, most, others):
    """Class of every token, by hand: frequent tokens, then frequent endings, then the last byte."""
    wanted = int(np.clip(np.sqrt(len(counts)), least, most)) - others
    key = {t: int(h) for t, h in zip(counts, scoring.hashes_of(list(counts)))}
    often = sorted((t for t in counts if counts[t] > 1), key=lambda t: (-counts[t], key[t]))[: wanted // 2]
    own = sorted({*often, scoring.END}, key=key.get)
    endings = Counter()
    for t in counts:
        if t not in own:
            endings[int.from_bytes(t[-3:])] += counts[t]
    kept = sorted(sorted(endings, key=lambda e: (-endings[e], e))[: wanted - wanted // 2])

    def of(token):
        ending = int.from_bytes(token[-3:])
        if token in own:
            return own.index(token)
        return len(own) + (kept.index(ending) if ending in kept else len(kept) + ending % others)

    return of, len(own), len(own) + len(kept) + others


@pytest.mark.parametrize("words, classes", [(10, (64, 2048)), (60, (24, 30))])
def test_scores_against_enumeration(spark, monkeypatch, words, classes):
    """The score of each text from counts made by hand, and chances that sum to one over all tokens and unseen ones."""
    monkeypatch.setattr(scoring, "LEAST_CLASSES", classes[0])
    monkeypatch.setattr(scoring, "MOST_CLASSES", classes[1])
    draw = np.random.default_rng(2)
    names = [f"{a}{b}{'xyz'[k % 3]}" for k, (a, b) in enumerate((chr(97 + i % 26), chr(97 + i // 26)) for i in range(words))]
    rows = [(k, " ".join(names[int(x) % words] for x in draw.zipf(1.4, int(draw.integers(0, 12))))) for k in range(60)]
    rows += [(100 + k, f"once{k}x seen {names[0]}") for k in range(6)]
    tokens, counts = plain_counts(rows)
    of, own, size = small_classes(counts, *classes, scoring.OTHERS)
    pairs = np.zeros((size, size))
    for (i, _), text in zip(rows, tokens):
        if crc_fold(i, 7) not in (None, 2):
            for a, b in zip([scoring.END, *text], text):
                pairs[of(a), of(b)] += 1
    chances = scoring.train_classes(pairs) / np.log(10)
    inside, unseen = defaultdict(int), defaultdict(int)
    for t, n in counts.items():
        inside[of(t)] += n
        unseen[of(t)] += n == 1
    reserve = {c: 0 if c < own else max(unseen[c], scoring.LEAST_UNSEEN) for c in range(size)}

    def chance(before, token):
        c = of(token)
        return chances[of(before), c] + np.log10((counts[token] or reserve[c]) / (inside[c] + reserve[c]))

    found = {r["doc_id"]: r["score"] for r in check(spark, rows)}
    for (i, _), text in zip(rows, tokens):
        assert found[i] == pytest.approx(sum(chance(a, b) for a, b in zip([scoring.END, *text], text)), rel=1e-5)
    for before in [scoring.END, b"never seen", names[0].encode(), names[-1].encode()]:
        seen = sum(10 ** chance(before, t) for t in counts)
        rest = sum(10 ** chances[of(before), c] * reserve[c] / (inside[c] + reserve[c]) for c in range(size))
        assert seen + rest == pytest.approx(1, abs=1e-5)


def test_held_out_texts_score_above_the_base(spark):
    found = scoring.op9_lm_score(spark, DATA).collect()
    for held in (True, False):
        own = [r for r in found if r["held_out"] == held]
        tokens = sum(r["n_tokens"] for r in own)
        assert sum(r["score"] for r in own) / tokens > sum(r["base_score"] for r in own) / tokens + 0.1


def test_chances_are_normalised_and_follow_the_counts():
    draw = np.random.default_rng(3)
    pairs = np.zeros((200, 200))
    hidden = draw.dirichlet(np.full(6, 0.3), 6)
    pairs[:6, :6] = hidden * 10_000
    chances = np.exp(scoring.train_classes(pairs))
    assert np.allclose(chances.sum(axis=1), 1)
    order = pairs[:6, :6].sum(axis=0) / pairs.sum()
    model = (pairs[:6, :6] * np.log(chances[:6, :6])).sum()
    assert model > (pairs[:6, :6] * np.log(order)).sum()  # better than without the class before
    assert np.allclose(np.exp(scoring.train_classes(np.zeros_like(pairs))).sum(axis=1), 1)


def test_classes_grow_with_the_vocabulary(spark):
    def classes(words):
        rows = [(k, " ".join(f"w{k}x{i} w{k}x{i}" for i in range(words // 50))) for k in range(60)]
        texts = scoring.dealt(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", (7, 2))
        return scoring.train(texts, scoring.counted_tokens(texts)).classes.count

    assert classes(100) < classes(8_000) < classes(30_000)


def test_partitions_do_not_matter(spark):
    rows = [(k, " ".join(f"t{(k * i) % 37}" for i in range(k % 9))) for k in range(50)]
    one, many = ({r["doc_id"]: r["score"] for r in check(spark, rows, parts)} for parts in (1, 6))
    assert one == pytest.approx(many, rel=1e-5)
