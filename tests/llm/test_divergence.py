import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tillsight.llm import divergence

WORDS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id bigint, text string, lang string, source string"


def plain(rows, least=30, added=5, scale=10**9, top=50):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = WORDS.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    found = []
    for lang in docs.keys() | {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}

        def share(counts):
            return {t: 1 + scale * (counts[t] + added) // (sum(counts.values()) + added * len(kept)) for t in kept}

        shares = {s: share(c) for s, c in own.items()}
        whole = share({t: sum(c[t] for c in own.values()) for t in kept})
        for s, p in shares.items():
            pairs = [(-sum(abs(p[t] - q[t]) for t in kept), o) for o, q in shares.items() if o != s]
            terms = [(whole[t] - p[t], t) for t in kept if own[s][t] and p[t] > whole[t]]
            for part, values in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(values, 1)]
    return sorted(found)


def run(spark, rows, parts=3, **how):
    documents = spark.createDataFrame(rows, KIND).repartition(parts)
    found = divergence.source_divergence(documents, **how)
    return sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n, seed=1, vocabulary=60):
    draw = random.Random(seed)
    words = [f"{chr(97 + k % 26)}Wört{chr(97 + k // 26)}" for k in range(vocabulary)] + ["THE", "é", "日本", "a-b", "x9y"]
    rows = []
    for k in range(n):
        text = " ".join(draw.choice(words[: draw.randint(1, len(words))]) for _ in range(draw.randint(0, 40)))
        rows.append((k, text, draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "c", None, "é"])))
    return rows


@pytest.mark.parametrize("block,segment,merged", [(400_000, 4096, 500_000), (50, 3, 10), (1, 1, 1)])
def test_against_plain_counts(spark, monkeypatch, block, segment, merged):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(divergence, "SEGMENT", segment)
    monkeypatch.setattr(divergence, "MERGED_POSTINGS", merged)
    rows = corpus(150) + [(1000, "only here once", "fr", "a"), (1001, None, "fr", "b"), (1002, "", "xx", "b")]
    rows += [(1003, "copy of a row", "de", "c")] * 40
    assert run(spark, rows, least=4, top=3) == plain(rows, least=4, top=3)


def test_corrections_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 7)
    monkeypatch.setattr(divergence, "HELD", 1)
    rows = corpus(120, seed=4)
    assert run(spark, rows, least=3) == plain(rows, least=3)


def test_partitions_do_not_matter(spark):
    rows = corpus(200, seed=2)
    assert run(spark, rows, parts=1) == run(spark, rows, parts=9) == plain(rows)


def test_languages_without_kept_terms(spark):
    rows = [(1, "some words", "en", "a"), (2, "other words", "en", "b"), (3, None, None, None)]
    assert run(spark, rows) == plain(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_ties_go_by_item(spark):
    rows = [(k, "zz yy xx", "en", "s") for k in range(30)] + [(k, "qq", "en", f"t{k % 4}") for k in range(120)]
    found = run(spark, rows, top=2)
    assert found == plain(rows, top=2)
    assert [r[3] for r in found if r[1] == "s" and r[2] == "term"] == ["xx", "yy"]


def test_edges(spark, edge, nothing):
    wanted = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in edge.collect()]
    found = divergence.source_divergence(edge, least=1)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == plain(wanted, least=1)
    assert divergence.source_divergence(nothing).count() == 0


def test_merge_settles_whole_keys(monkeypatch):
    """A part has all postings of its keys and none of later ones, in any cut of the runs."""
    monkeypatch.setattr(divergence, "MERGED_POSTINGS", 7)
    draw = random.Random(5)
    runs = [sorted(b"en\x00%03d" % draw.randint(0, 40) for _ in range(30)) for _ in range(6)]
    segments = [run[i : i + n] for run, n in zip(runs, (1, 2, 5, 7, 30, 4)) for i in range(0, 30, n)]
    segments.sort(key=lambda s: s[0])
    tables = [pa.table([pa.array(s, pa.binary()), ["s"] * len(s), [1] * len(s), [1] * len(s)], names=divergence.COLUMNS) for s in segments]
    parts = [sorted(p.column("keys").to_pylist()) for p in divergence.merged_runs(iter(tables)) if p.num_rows]
    assert len(parts) > 5 and sorted(k for p in parts for k in p) == sorted(k for r in runs for k in r)
    assert all(a[-1] < b[0] for a, b in zip(parts, parts[1:]))


def test_shares_beyond_64_bits():
    counts, weights = np.array([5, 10**13, 3 * 10**17]), np.array([7, 10**15, 4 * 10**17])
    assert divergence.shares(counts, weights, 10**9).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(counts, weights)]
