"""Byte-pair encoding and decoding with the vocabulary of a byte-level tokenizer file.

A piece of text between pre-token borders is a doubly linked list of symbols. A priority queue holds the
merges that are possible, by rank and then by place; an entry whose symbols have changed since it was queued
is skipped when it comes out. Decoding joins the byte strings of the vocabulary.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from pathlib import Path

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm.common import map_texts, sha256_hex, table

#: Encoded pre-tokens a task remembers in each of two generations, and the longest one worth it.
REMEMBERED = 250_000
REMEMBERED_CHARS = 48
PLACE = (1 << 40) - 1

# White space and the borders between pre-tokens, as the tokenizer file's pre-tokenizer defines them.
SPACES = r"\t\n\x0b\f\r \x85\xa0  -     　"
ASCII_SPACES = r"\t\n\x0b\f\r "
BORDERS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^SPACES\p{L}\p{N}]+|[SPACES]+(?![^SPACES])|[SPACES]+"
)

_ANY = regex.compile(BORDERS.replace("SPACES", SPACES))
_ASCII = re.compile(
    BORDERS.replace("SPACES", ASCII_SPACES)
    .replace(r"\p{L}\p{N}", "A-Za-z0-9")
    .replace(r"\p{L}", "[A-Za-z]")
    .replace(r"\p{N}", "[0-9]")
)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(0x100)]


class Bpe:
    """Encoder and decoder for one vocabulary.

    `definition` is the text of a tokenizer file of byte-level BPE without normalizer, prefix space or
    truncation; anything else is refused.
    """

    def __init__(self, definition: str | bytes):
        whole = json.loads(definition)
        model, before = whole["model"], whole["pre_tokenizer"]
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback")
        if not plain or whole["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        strings |= {i: s.encode() for s, i in self.special.items()}
        self.size = max(strings) + 1
        self.strings = [strings.get(i, b"") for i in range(self.size)]
        self.decimals = [str(i) for i in range(self.size)]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] * self.size + vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token. A queue entry is the rank of a merge above the place of its left symbol."""
        first, size, rank_of = self.first, self.size, self.ranks.get
        symbols = [first[b] for b in data]
        count = len(symbols)
        queue = []
        for i in range(count - 1):
            if (rank := rank_of(symbols[i] * size + symbols[i + 1])) is not None:
                queue.append(rank << 40 | i)
        if not queue:
            return symbols
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & PLACE
            if (left := symbols[i]) < 0 or (j := after[i]) >= count:
                continue
            rank = entry >> 40
            if rank_of(left * size + symbols[j]) != rank:
                continue
            symbols[i] = made = self.made[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < count:
                before[k] = i
                if (rank := rank_of(made * size + symbols[k])) is not None:
                    heappush(queue, rank << 40 | i)
            if (h := before[i]) >= 0 and (rank := rank_of(symbols[h] * size + made)) is not None:
                heappush(queue, rank << 40 | h)
        return [s for s in symbols if s >= 0]

    def parts(self, text: str) -> list[tuple[list[str], int | None]]:
        """Pre-tokens up to each special token, and that token's id (None at the end)."""
        found = self.split.split(text) if self.split else [text]
        return [
            (pre_tokens(found[i]), self.special[found[i + 1]] if i + 1 < len(found) else None) for i in range(0, len(found), 2)
        ]

    def encode(self, text: str, memory: Memory | None = None) -> list[int]:
        memory = Memory(self) if memory is None else memory
        ids: list[int] = []
        for tokens, special in self.parts(text):
            for made in map(memory.__getitem__, tokens):
                ids += made
            if special is not None:
                ids.append(special)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        return self.decoded_bytes(ids).decode("utf-8", "replace")

    def decoded_bytes(self, ids: list[int]) -> bytes:
        strings, size = self.strings, self.size
        try:
            return b"".join([strings[i] for i in ids])
        except IndexError:
            return b"".join([strings[i] for i in ids if i < size])

    def csv(self, ids: list[int]) -> str:
        decimals = self.decimals
        return ",".join([decimals[i] for i in ids])


class Memory(dict):
    """Ids by pre-token; what was not asked for during a whole generation is forgotten."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.older: dict[str, list[int]] = {}

    def __missing__(self, token: str) -> list[int]:
        made = self.older.get(token)
        if made is None:
            made = self.bpe.merge(token.encode())
        if len(token) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[token] = made
        return made


def pre_tokens(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _ANY).findall(text)


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(bpe: Bpe, ids: list[int], decoded: str) -> tuple[int, str, str]:
    return len(ids), sha256_hex(bpe.csv(ids).encode()), sha256_hex(decoded.encode())


def ids_only(bpe: Bpe, ids: list[int], decoded: str) -> tuple[list[int]]:
    return (ids,)


def ids_and_digests(bpe: Bpe, ids: list[int], decoded: str) -> tuple:
    return ids, *digests(bpe, ids, decoded)


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def tokenize(
    documents: DataFrame,
    tokenizer_file: str | None = None,
    text: str = "text",
    results: str = "ids array<int>",
    derive: Callable[[Bpe, list[int], str], tuple] = ids_only,
    keep: list[str] | None = None,
) -> DataFrame:
    """Encode every whole text and decode it again; `derive` makes the result columns from ids and decoded text.

    A null text counts as empty: no ids, empty decoded text. Texts of any length are encoded whole. Rows are
    independent, so repeated rows give repeated results; an empty table stays empty. Input columns named like a
    result are replaced, the others stay (or those in `keep`). The tokenizer file is read once on the driver,
    by default the public byte-level vocabulary of the environment, and has a fixed size.
    """
    definition = documents.sparkSession.sparkContext.broadcast(Path(tokenizer_file or default_file()).read_bytes())

    def make():
        bpe = Bpe(definition.value)
        memory = Memory(bpe)

        def compute(texts):
            made = []
            for value in texts:
                ids = bpe.encode(value.decode("utf-8", "replace"), memory) if value else []
                made.append(derive(bpe, ids, bpe.decode(ids)))
            return [list(column) for column in zip(*made)]

        return compute

    return map_texts(documents, text, results, make, keep)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize(documents, results=DIGESTS, derive=digests, keep=["doc_id"]).select(
        "doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256"
    )
