import random

import pytest
from tokenizers import Tokenizer

from tillsight.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = bpe.default_file()
    with open(path, "rb") as file:
        return Tokenizer.from_file(path), bpe.Bpe(file.read())


def test_same_as_the_library(both):
    library, own = both
    draw = random.Random(1)
    letters = ["a", "e", "the", " ", "  ", "\n", "'s", "'ll", "1", "23", "!", "###", "é", "東", "\xa0", "<|endoftext|>", "\x1c", "🙂", "Ġ", "́", "½"]
    memory = bpe.Memory(own)
    for _ in range(400):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text, memory) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_borders_of_every_kind_of_character(both):
    library, own = both
    for code in [*range(0x3000), *range(0x3000, 0x110000, 997)]:
        if not 0xD800 <= code < 0xE000:
            text = f"a {chr(code) * 2} b1{chr(code)}  x"
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(code)


def test_long_words_and_forgetting(both, monkeypatch):
    library, own = both
    text = "ab" * 20_000 + " " + "x" * 5_000
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    memory = bpe.Memory(own)
    words = [f"w{i % 7} v{i % 3}" for i in range(60)]
    assert [own.encode(w, memory) for w in words] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert len(memory) <= 3


def test_decoding_any_ids(both):
    library, own = both
    draw = random.Random(2)
    for _ in range(200):
        ids = [draw.randrange(50257) for _ in range(draw.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([10**6]) == ""


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe('{"model": {"type": "WordPiece"}, "pre_tokenizer": {"type": "ByteLevel"}, "normalizer": null, "added_tokens": []}')


def test_edges(edge, nothing, both):
    library, _ = both
    found = bpe.tokenize(edge, results=f"ids array<int>, {bpe.DIGESTS}", derive=bpe.ids_and_digests)
    assert sorted(c.lower() for c in found.columns).count("n_tokens") == 1 and "shard" in found.columns
    for r in found.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == bpe.sha256_hex(",".join(map(str, r["ids"])).encode())
        assert r["decoded_sha256"] == bpe.sha256_hex((r["text"] or "").encode())
    assert found.count() == 11 and bpe.tokenize(nothing).count() == 0
