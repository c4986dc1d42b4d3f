import numpy as np
import pytest

from tillsight.llm import language
from tillsight.llm.common import crc_fold

DATA = "/root/testdata/sf0.01"


def test_subwords_are_those_of_the_words():
    def plain(text):
        found = []
        for word in text.translate(language._LETTERS).split():
            padded = b" " + word + b" "
            for size in language.SIZES:
                found += [padded[i : i + size] for i in range(len(padded) - size + 1)]
        return found

    def buckets(text):
        return np.sort(np.concatenate(list(language.subwords(text)) or [np.zeros(0, np.int64)]))

    for text in [b"Hello, world! it's", b"a", "Été où".encode(), b"ab cd", b" x  y "]:
        single = []
        for gram in plain(text):
            code = np.zeros(1, np.uint32)
            for byte in gram:
                code = code * np.uint32(257) + np.uint32(byte)
            single.append(int((code * language._MIX[len(gram)])[0] >> np.uint32(17)))
        assert sorted(single) == buckets(text).tolist()


def test_long_texts_are_read_whole(monkeypatch):
    text = " ".join(f"word{chr(97 + i % 26)}" for i in range(3_000)).encode()
    whole = np.sort(np.concatenate(list(language.subwords(text))))
    monkeypatch.setattr(language, "CHUNK", 101)
    assert np.array_equal(whole, np.sort(np.concatenate(list(language.subwords(text)))))


def test_letters():
    assert not any(map(language.has_letter, [None, b"", b" \n", b"12 !", "½ 。".encode()]))
    assert all(map(language.has_letter, [b"1a", "é".encode(), "東".encode()]))


def test_held_out_accuracy_and_rejection(spark):
    found = {r["doc_id"]: r for r in language.op5_language(spark, DATA).collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    assert found.keys() == langs.keys()
    assert all(r["held_out"] == (crc_fold(i, 5) == 0) for i, r in found.items())
    held = [(r["lang_pred"], langs[i]) for i, r in found.items() if r["held_out"] and langs[i] is not None]
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_a_hot_row_leaves_no_language_out(spark, parts):
    german = [(k, f"der Hund und die Katze gehen nicht in das Haus {k}", "de") for k in range(400)]
    english = [(1000 + k, f"the dog and the cat do not go into the house {k}", "en") for k in range(400)]
    hot = [(5000 + k, "the same english row over and over again", "en") for k in range(4000)]
    rows = spark.createDataFrame(german + english + hot, "doc_id int, text string, lang string").repartition(parts)
    model = language.train(rows, per_language=50)
    assert model.languages == ["de", "en"]
    assert model.predict(b"und die Katze ist nicht der Hund")[0] == "de" and model.predict(b"the cat is not the dog")[0] == "en"


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda sample: seen.append(sample) or language.LanguageModel())
    rows = [(k, " ".join(f"{w}{k}x{i}" for i in range(300)), lang) for k in range(40) for w, lang in (("a", "x"), ("b", "y"))]
    rows += [(99, "short text", "z"), (1, "same text", "z"), (2, "same text", "z")]
    known = spark.createDataFrame([(3 * i + 1, t, lang) for i, (_, t, lang) in enumerate(rows)], "doc_id int, text string, lang string")
    language.train(known, most_bytes=60_000)
    sizes = {lang: sum(8 * len(b) for b, _, name in seen[0] if name == lang) for lang in "xyz"}
    assert 0 < sizes["x"] <= 20_000 and 0 < sizes["y"] <= 20_000 and sizes["z"] > 0
    assert sum(name == "z" for *_, name in seen[0]) <= 2
    language.train(known, most_bytes=1)
    assert sorted(name for *_, name in seen[1]) == ["x", "y", "z"]


def test_edges(spark, edge, nothing):
    rows = [(k, t, lang) for k in range(60) for t, lang in [(f"the thing of that {k}", "en"), (f"que los niños son {k}", "es")]]
    known = spark.createDataFrame([(2 * i, t, lang) for i, (_, t, lang) in enumerate(rows)], "doc_id int, text string, lang string")
    model = language.train(known)
    assert model.languages == ["en", "es"] and model.predict(b"the that of")[0] == "en" and model.predict("los niños".encode())[0] == "es"
    renamed = edge.withColumnRenamed("key", "Lang_Pred")
    for r in language.with_language(renamed, model).collect():
        nobody = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == nobody and (r["lang_score"] == 0) == nobody and not (nobody and r["lang_accepted"])
    blank = language.train(nothing)
    assert blank.languages == [] and {r["lang_pred"] for r in language.with_language(edge, blank).collect()} == {"und"}
    assert language.with_language(nothing, model).count() == 0
