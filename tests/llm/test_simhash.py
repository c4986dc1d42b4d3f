import random

import numpy as np
import xxhash

from tillsight.llm import simhash
from tillsight.llm.graph import Forest, connected_components


def plain_fingerprint(text, size=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, most):
    reach = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= most and reach[i] != reach[j]:
                    reach[i] = reach[j] = min(reach[i], reach[j])
                    changed = True
    least = {}
    for root, one in zip(reach, ids):
        if one is not None:
            least[root] = min(one, least.get(root, one))
    return [least.get(root) for root in reach]


def test_fingerprints():
    for text in [None, "", " \n", "One", "one TWO", "a b c d e\tf\x0bg", "x x x x x x", "é\xa0É z y", "w " * 70_000]:
        assert simhash.fingerprint(text and text.encode()) == plain_fingerprint(text)


def test_trie_pairs_are_all_pairs():
    draw = np.random.default_rng(3)
    for most in (0, 1, 3):
        base = draw.integers(0, 1 << 63, 12, dtype=np.uint64)
        noise = np.array([sum(1 << int(b) for b in draw.integers(0, 64, draw.integers(0, 4))) & (2**64 - 1) for _ in range(400)], np.uint64)
        prints = np.unique(base[draw.integers(0, 12, 400)] ^ noise)
        cut = len(prints) // 3
        first, last = np.array([0, cut]), np.array([cut, len(prints)])
        found = {(int(a), int(b)) for x, y in simhash.trie_pairs(prints, first, last, most) for a, b in zip(x, y)}
        wanted = {
            (i, j)
            for s, e in zip(first, last)
            for i in range(s, e)
            for j in range(i + 1, e)
            if bin(int(prints[i]) ^ int(prints[j])).count("1") <= most
        }
        assert {tuple(sorted(p)) for p in found} == wanted


def test_components_with_and_without_split_tries(spark):
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(120)]
    texts = []
    for k in range(160):
        words = [base[(k % 5) * 20 + i % 20] for i in range(40)]
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(40)] = draw.choice(base)
        texts.append(" ".join(words))
    ids = [draw.randrange(1000) if draw.random() < 0.95 else None for _ in texts]
    documents = spark.createDataFrame(list(zip(ids, texts)), "doc_id int, text string")
    wanted = plain_components([plain_fingerprint(t) for t in texts], ids, 3)
    # Every row's component: by text, as ids may repeat.
    by_text = {(i, plain_fingerprint(t)): c for i, t, c in zip(ids, texts, wanted)}
    for trie_size in (200_000, 3):
        found = simhash.near_duplicates(documents, trie_size=trie_size).collect()
        assert len(found) == 160
        for r in found:
            assert r["component_id"] == by_text[(r["doc_id"], r["fingerprint_bits"] % (1 << 64))]


def test_edges(spark, edge, nothing):
    found = simhash.near_duplicates(edge).collect()
    assert len(found) == 11
    for r in found:
        wanted = {1: 1, 5: 1, 2: 2, 3: 2, 4: 2, 7: 7, 8: 8, 9: 9}
        if r["doc_id"] is None:
            assert r["component_id"] == (2 if r["fingerprint_bits"] == 0 else None)
        else:
            assert r["component_id"] == wanted[r["doc_id"]]
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] or 0, r["text"] is None) for r in kept.collect()) == [(0, False), (1, False), (2, True), (7, False), (8, False), (9, False)]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_connected_components(spark):
    draw = random.Random(6)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(60, 99)] + [(200, 200), (5, 5)]
    pairs += [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)]
    forest = Forest(401)
    forest.join(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    roots = forest.roots()
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: int(roots[x]) for x in linked}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
