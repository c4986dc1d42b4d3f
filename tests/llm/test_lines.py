import random
from fractions import Fraction

import pytest

from tillsight.llm import lines


def plain_tokens(line, size=5):
    words = [w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain_result(rows, size=5, least=Fraction(4, 5)):
    """Remaining text by (id, text): classes by comparing all lines, the first place of each stays."""
    places = [
        ((i is not None, i or 0, text), pos, line)
        for i, text in set(rows)
        if text is not None
        for pos, line in enumerate(text.split("\n"))
    ]
    sets = [plain_tokens(line, size) for *_, line in places]
    distinct = list({s for s in sets if s})
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if len(a & b) >= least * len(a | b):
                root[find(a)] = find(b)
    groups = {}
    for place, s in zip(places, sets):
        if s:
            groups.setdefault(find(s), []).append(place)
    return places, groups


def check(spark, rows, size=5):
    found = lines.remove_lines(spark.createDataFrame(rows, "doc_id int, text string"), size=size).collect()
    assert len(found) == len(rows)
    places, groups = plain_result(rows, size)
    removed = {(r["doc_id"], pos) for r in found for pos in r["removed_lines"]}
    for group in groups.values():
        stay = [(key, pos) for key, pos, _ in group if (key[1] if key[0] else None, pos) not in removed]
        assert len({p for p in stay}) == 1, group
        # The smallest id; ids are unique here.
        assert min((key[:2], pos) for key, pos, _ in group) == (stay[0][0][:2], stay[0][1])
    blank = [(key, pos) for key, pos, line in places if not plain_tokens(line, size)]
    assert not any((key[1] if key[0] else None, pos) in removed for key, pos in blank)
    text_of = dict(rows)
    for r in found:
        whole = text_of[r["doc_id"]]
        if whole is None:
            assert r["text"] is None and (r["n_lines"], r["n_removed"]) == (0, 0)
        else:
            left = [line for pos, line in enumerate(whole.split("\n")) if pos not in r["removed_lines"]]
            assert r["text"] == "\n".join(left) and r["n_lines"] == whole.count("\n") + 1 and r["n_removed"] == len(r["removed_lines"])


def test_against_all_pairs(spark):
    draw = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([3, 7, 30, 60, 95]))] for _ in range(8)]

    def line():
        words = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        return draw.choice(["", "\t"]) + " ".join(words) + draw.choice(["", "\r", "  "])

    rows = [(k, "\n".join(line() if draw.random() < 0.9 else " " for _ in range(draw.randint(1, 4)))) for k in range(60)]
    check(spark, rows + [(None, rows[3][1]), (100, None), (101, "")])
    check(spark, rows[:30], size=1)


def test_shingles(spark):
    from pyspark.sql import functions as F

    for size in (1, 2, 3, 5, 7):
        words = ["a b c d e f g h", "a a a a a a a a a", "a", "a b c", "h g f e d c b a b c d"]
        made = lines.with_shingles(spark.createDataFrame([(w,) for w in words], "w string").select("w", F.split("w", " ").alias("words")), size)
        for r in made.collect():
            assert len(set(r["shingles"])) == len(plain_tokens(r["w"], size))


def test_a_text_is_split_once(spark):
    """Neither a filter nor the next step splits a text or a line again; lines without words are left out."""
    odd = [" ", "\t \r", "", "A b", "\tc  D\r", " e\tf ", "g\rh", "\u00a0", "K \u0130"]
    made = lines.lines_of(spark.createDataFrame([(1, "\n".join(odd)), (2, ""), (3, None)], "doc_id int, text string"), "doc_id", "text")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "array_" not in plan
    assert sorted((r["doc_id"], r["pos"], r["line"]) for r in made.collect()) == [(1, k, odd[k]) for k in range(3, 9)]
    found = {r["line"]: r["words"] for r in lines.with_words(made).join(made, "key").collect()}
    assert found == {line: [w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w] for line in odd[3:]}


def test_near_copies_link_without_their_pairs(spark):
    """A hub joins a group of near copies; lines that only meet in hot tokens stay apart."""
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(40):
        words = list(base)
        words[(7 * k) % 150] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(base[:40] + [f"y{k}-{j}" for j in range(100)])) for k in range(10)]
    check(spark, rows)


@pytest.mark.parametrize("vocabulary", [200, 20_000])
def test_variants_are_not_paired_all_with_all(spark, monkeypatch, vocabulary):
    """Two of eighteen words changed: the pairs that are verified stay near those that are linked."""
    verified = []
    real = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *more: verified.append(pairs.count()) or real(pairs, *more))
    for count in (500, 2000):
        draw = random.Random(3)
        rows = []
        for k in range(count):
            words = [f"w{i}" for i in range(18)]
            for place in draw.sample(range(18), 2):
                words[place] = f"v{draw.randrange(vocabulary)}"
            rows.append((k, " ".join(words)))
        verified.clear()
        lines.remove_lines(spark.createDataFrame(rows, "doc_id int, text string")).count()
        assert sum(verified) <= count  # with all pairs it would be thousands of times that


def test_a_shared_passage_does_not_pass_the_first_cut(spark, monkeypatch):
    """Lines that share only a few rare words are done before their tokens are counted."""
    draw = random.Random(5)
    rows = []
    for k in range(60):
        words = [f"w{draw.randrange(300)}" for _ in range(50)]
        words[20:20] = [f"passage{k // 2}word{i}" for i in range(6)]
        rows.append((k, " ".join(words)))
    near = rows[7][1].split()
    near[40] = "changed"
    rows.append((100, " ".join(near)))
    kept = []
    real = lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: kept.append(name == "contested-keys" and df.count()) or real(df, name))
    found = lines.remove_lines(spark.createDataFrame(rows, "doc_id int, text string"))
    assert [r["doc_id"] for r in found.where("n_removed > 0").collect()] == [100]
    assert max(kept) == 2  # the near copies only


@pytest.mark.parametrize("vocabulary", [2, 5, 40])
def test_first_cut_keeps_similar_lines(spark, vocabulary):
    """Every line with a similar one passes, also where words repeat and sketched tokens are fewer than shingles."""
    from pyspark.sql import functions as F

    draw = random.Random(7)
    rows = []
    for k in range(40):
        words = [("v" * draw.choice([1, 3])) + str(draw.randrange(vocabulary)) for _ in range(draw.choice([1, 4, 5, 6, 12, 30, 90]))]
        for _ in range(4):
            rows.append(" ".join(words))
            at = draw.randrange(len(words))
            words = words[:at] + [f"x{draw.randrange(50)}"] * draw.choice([0, 1, 2]) + words[at + draw.choice([0, 1]):] or ["x"]
    sets = {r: plain_tokens(r) for r in rows}
    similar = {a for a in sets for b in sets if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    frame = spark.createDataFrame([(r,) for r in rows], "line string").withColumn("key", F.xxhash64("line"))
    met = lines.met_keys(lines.sketched_lines(frame, 5, Fraction(4, 5)), Fraction(4, 5))
    passed = {r["line"] for r in frame.join(met, "key").collect()}
    assert len(similar) >= 15 and similar <= passed


def test_edges(spark, edge, nothing):
    found = lines.remove_lines(edge)
    assert sorted(found.columns) == sorted(edge.columns + ["n_lines", "n_removed", "removed_lines"])
    rows = found.collect()
    assert len(rows) == 11
    for r in rows:
        if r["doc_id"] == 1:  # two equal rows are one: both keep the first lines
            assert r["n_removed"] == 0
        elif r["doc_id"] == 5:
            assert (r["n_lines"], r["n_removed"], r["text"]) == (2, 2, "")
        elif r["doc_id"] == 4:
            assert (r["n_lines"], r["n_removed"], r["text"]) == (2, 0, " \n\t ")
        elif r["text"] is None:
            assert (r["n_lines"], r["n_removed"]) == (0, 0)
    assert lines.remove_lines(nothing).count() == 0


def test_long_lists_of_removed_lines_are_not_sent(spark, monkeypatch):
    from tillsight.llm import common

    monkeypatch.setattr(common, "SENT_VALUES", 5, raising=False)
    gone = spark.createDataFrame([(1, list(range(4))), (2, list(range(4)))], "id int, gone array<int>")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert not hinted(common.sent_if_small(gone, "gone")) and hinted(common.sent_if_small(gone.limit(1), "gone"))
    documents = spark.createDataFrame([(k, "\n".join(["the same line over again"] * 8)) for k in range(2)], "doc_id int, text string")
    sent = []
    monkeypatch.setattr(lines, "sent_if_small", lambda df, *array: sent.append((df.columns, array)) or common.sent_if_small(df, *array))
    found = lines.remove_lines(documents)
    assert sorted(r["n_removed"] for r in found.collect()) == [7, 8]
    assert [array for columns, array in sent if "__llm_gone" in columns] == [("__llm_gone",)]
