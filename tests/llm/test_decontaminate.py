import random

import pytest

from tillsight.llm import decontaminate as dc


def brute(words, items, size=13):
    hit, found = set(), set()
    for item, text in items:
        own = dc.words_of(text)
        for window in dc.windows_of(own, size):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
    return hit, found


def random_text(draw, n, letters="abc"):
    return " ".join(draw.choice(letters) for _ in range(n))


def test_words():
    assert dc.words_of(b"A-b_c9 \xc3\x89t\xc3\xa9\x00x") == [b"a", b"b", b"c9", "Été".encode(), b"x"]
    assert dc.words_of(None) == [] and dc.words_of(b"") == [] and dc.words_of(b"?!") == []


@pytest.mark.parametrize("block", [1, 2, 3])
def test_search_finds_what_brute_force_finds(block):
    draw = random.Random(block)
    for _ in range(150):
        size = draw.choice([3, 5])
        items = [(str(k), random_text(draw, draw.randint(0, 9)).encode()) for k in range(draw.randint(0, 6))]
        words = dc.words_of(random_text(draw, draw.randint(0, 60)).encode())
        spans, found = dc.search(words, dc.build_searches(items, size, block))
        hit, wanted = brute(words, items, size)
        assert {k for a, b in spans for k in range(a, b + 1)} == hit and found == wanted
        assert all(x[1] + 1 < y[0] for x, y in zip(spans, spans[1:]))


def test_equal_windows_of_many_items_are_one():
    items = [(str(k), b"one two three four five six") for k in range(50)] + [("x", b"one two three four five seven"), (None, b"two three four")]
    searches = dc.build_searches(items, 4, 2)
    assert [len(s.first) for s in searches.lengths] == [1, 4]
    spans, found = dc.search(dc.words_of(b"zero one two three four nine four five six two three four five seven"), searches)
    assert spans == [(1, 4), (9, 13)] and found == {str(k) for k in range(50)} | {"x", None}


def test_tables_of_a_large_benchmark_stay_small():
    """Four megabytes of text: flat arrays, not objects for each window."""
    import tracemalloc

    draw = random.Random(9)
    words = [f"w{k}" for k in range(30_000)]
    items = [(str(k), " ".join(draw.choices(words, k=700)).encode()) for k in range(1_000)]
    tracemalloc.start()
    searches = dc.build_searches(items, 13, 2)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100 << 20
    text = dc.words_of(items[500][1])
    assert dc.search(text, searches) == ([(0, len(text) - 1)], {"500"})


def test_passes_agree_and_rows_stay(spark, edge):
    draw = random.Random(5)
    texts = [random_text(draw, 80) for _ in range(30)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    items = [(k, random_text(draw, draw.randint(1, 8))) for k in range(12)] + [(3, texts[0][:21]), (None, "a b c a b"), (None, None), (4, "")]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    once = {r["doc_id"]: r for r in dc.find_contamination(documents, benchmark, window=5).collect()}
    many = {r["doc_id"]: r for r in dc.find_contamination(documents, benchmark, window=5, pass_bytes=60).collect()}
    assert once == many and len(once) == 30
    known = [(None if k is None else str(k), t and t.encode()) for k, t in items]
    for k, text in enumerate(texts):
        hit, found = brute(dc.words_of(text.encode()), known, 5)
        assert once[k]["n_hit"] == len(hit) and once[k]["hit_items"] == sorted(found - {None})


def test_edges(spark, edge, nothing):
    benchmark = spark.createDataFrame([(1, "the lazy dog and runs away from here a second line follows the first")], "item_id int, text string")
    found = dc.find_contamination(edge, benchmark)
    assert "n_words" in found.columns and sum(c.lower() == "n_words" for c in found.columns) == 1 and "key" in found.columns
    rows = found.collect()
    assert len(rows) == 11
    for r in rows:
        assert r["n_hit"] == (14 if r["doc_id"] in (1, 5) else 0)
        assert r["n_words"] == {1: 22, 5: 22, 2: 0, 3: 0, 4: 0, 7: 60_000, 8: 2, 9: 4, None: 4 if r["text"] else 0}[r["doc_id"]]
    assert dc.find_contamination(nothing, benchmark).count() == 0
    assert {r["n_hit"] for r in dc.find_contamination(edge, benchmark.limit(0)).collect()} == {0}
