import math
import random
import re
import textwrap

from tillsight.llm import licenses


def plain(text, templates, phrases=licenses.PHRASES, least=0.9):
    def words(t):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    whole = words(text)
    places = [
        (i, label)
        for phrase, label in phrases.items()
        for i in range(len(whole))
        if whole[i : i + len(phrase.split())] == phrase.split()
    ]
    shares = []
    for label, t in templates:
        parts = set(licenses.template_words(t))
        span = len(words(t)) + math.ceil(len(words(t)) / 10)
        shares += [(len(set(whole[i : i + span]) & parts) / len(parts), label) for i in range(len(whole))]
    held = [(s, label) for s, label in shares if s >= least - 1e-12]
    base = sorted({label for _, label in places})
    starts = [i for i, _ in places]
    return (
        len(whole), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
        ",".join(sorted(set(base) | {label for _, label in held})),
        1.0 if places else max((s for s, _ in held), default=0.0),
    )


def test_against_all_blocks(spark):
    draw = random.Random(1)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.template_words(t)}) + ["é", "x", "mit", "license", "general", "public"]
    rows = []
    for k in range(150):
        made = []
        for _ in range(draw.randint(0, 4)):
            words = draw.choice(licenses.TEMPLATES)[1].split() if draw.random() < 0.6 else draw.choices(vocabulary, k=draw.randint(0, 25))
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                if words:
                    words[draw.randrange(len(words))] = draw.choice(vocabulary)
            made.append(draw.choice([" ", "-", ", "]).join(words))
        rows.append((k, "\n".join(made)))
    rows += [(900, "MIT\nLicense mit license, mit-license"), (901, None), (902, "general public license")]
    documents = spark.createDataFrame(rows, "doc_id int, text string")
    for least in (0.9, 0.6):
        found = {r["doc_id"]: r for r in licenses.scan_licenses(documents, containment=least).collect()}
        for k, text in rows:
            assert tuple(found[k][c] for c in licenses.RESULTS) == plain(text, licenses.TEMPLATES, least=least), text


def test_edges(edge, nothing):
    found = licenses.scan_licenses(edge)
    assert sorted(c.lower() for c in found.columns).count("score") == 1 and "row" in found.columns
    rows = found.collect()
    assert len(rows) == 11 and {(r["n_base"], r["labels"], r["score"], r["first_word"]) for r in rows} == {(0, "", 0.0, None)}
    assert licenses.scan_licenses(nothing).count() == 0


def test_wrapped_notices_and_long_lines(spark):
    draw = random.Random(5)
    filler = [f"w{k}" for k in range(300)] + ["the", "of", "or", "and", "to", "in"]
    rows = []
    for k in range(120):
        label, notice = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        words = draw.choices(filler, k=draw.randint(0, 90)) + notice.split() + draw.choices(filler, k=draw.randint(0, 90))
        for _ in range(draw.choice([0, 0, 0, 1, 2, 4])):
            words.insert(draw.randrange(len(words)), draw.choice(filler))
        width = draw.choice([30, 75, 10_000])
        rows.append((k, "\n# ".join(textwrap.wrap(" ".join(words), width))))
    scattered = draw.choices(filler, k=20_000)
    for i, w in enumerate("Released under the BSD License".split()):
        scattered[i * 3_000] = w
    rows += [
        (900, " ".join(scattered)),
        (901, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"),
    ]
    mpl = next(t for label, t in licenses.TEMPLATES if label == "mpl").split()
    draw.shuffle(mpl)
    for length in (64, 65, 400):  # the length of a line says nothing
        rows.append((1000 + length, " ".join(draw.choices(filler, k=20) + mpl + draw.choices(filler, k=length - 20 - len(mpl)))))
        rows.append((2000 + length, " ".join(draw.choices(filler, k=length - 6) + "Released under the new BSD License".split())))
    phrases = {"no phrase": "none"}
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string"), phrases=phrases).collect()}
    for k, text in rows:
        assert tuple(found[k][c] for c in licenses.RESULTS) == plain(text, licenses.TEMPLATES, phrases), text
    assert all("mpl" in found[1000 + n]["labels"] and "bsd" in found[2000 + n]["labels"] for n in (64, 65, 400))
    assert (found[900]["labels"], found[901]["labels"]) == ("", "bsd")
    assert sum(r["labels"] != "" for r in found.values()) > 80
