"""Document quality from a chain of good and bad lines.

A linear-chain conditional random field labels the lines of a document; a line's score comes from its own
features and those of the lines beside it. Forward-backward gives each line's chance to be good, and the mean
of these, weighted by length, is the score of the document.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm.common import fold, map_texts, table
from tillsight.plans.shared import stored

#: Labelled documents the model is fitted on at most.
SAMPLE_DOCUMENTS = 6_000
#: Lines of all labelled documents together the model is fitted on at most.
SAMPLE_TOTAL_LINES = 400_000
EPOCHS = 150
STEP = 0.1
PENALTY = 1e-3

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGITS = bytes(range(0x30, 0x3A))
MARKS = b".,;:'\"-()?"
SYMBOLS = b"#$%&*|~^<>{}[]\\/=+_@`"
BEYOND = bytes(range(0x80, 0x100))
OWN = 16
BESIDE = 12


def line_features(lines: list[bytes]) -> np.ndarray:
    """Features of each line by itself; a line without words has zeros but for its place."""
    rows = []
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    for number, line in enumerate(lines):
        words = line.split()
        n, count = len(line), len(words)
        if not count:
            rows.append([0.0] * 15 + [float(number == 0)])
            continue
        upper = n - len(line.translate(None, UPPER))
        lower = n - len(line.translate(None, LOWER))
        beyond = n - len(line.translate(None, BEYOND))
        held = n - count
        rows.append(
            [
                np.log1p(n),
                np.log1p(count),
                n / count / 10,
                len(set(words)) / count,
                sum(map(eq, words, words[1:])) / count,
                upper / (upper + lower + 1),
                (n - len(line.translate(None, DIGITS))) / n,
                (upper + lower) / n,
                line.count(b"!") / count,
                (n - len(line.translate(None, SYMBOLS))) / count,
                (n - len(line.translate(None, MARKS))) / count,
                beyond / n,
                float(0x41 <= line[0] <= 0x5A),
                float(line[-1:] in b".!?"),
                float(seen[line] > 1 and held > 0),
                float(number == 0),
            ]
        )
    return np.array(rows, np.float32).reshape(-1, OWN)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and after, each with a mark that there is none."""
    before, after = np.zeros((len(own), BESIDE + 1), np.float32), np.zeros((len(own), BESIDE + 1), np.float32)
    before[1:, :BESIDE], after[:-1, :BESIDE] = own[:-1, :BESIDE], own[1:, :BESIDE]
    before[0, BESIDE] = after[-1, BESIDE] = 1
    return np.concatenate([own, before, after], axis=1)


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights (bytes that are not white space) of the lines of a text."""
    lines = text.split(b"\n")
    weights = np.array([len(b"".join(line.split())) for line in lines], np.float64)
    return with_neighbours(line_features(lines)), weights


class LineChain:
    """Two labels (0 bad, 1 good) with a weight per feature for good and a weight per pair of neighbouring labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        self.weights, self.pairs, self.mean, self.spread = weights, pairs, mean, spread

    def unary(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1]

    def marginals(self, unary: np.ndarray, lengths: np.ndarray, with_pairs: bool = False):
        """Chance of good for each line of documents that lie one after another; their expected label pairs."""
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        count, longest = len(sizes), int(sizes.max(initial=0))
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents longer than t
        forward = np.zeros((len(unary), 2))
        back = np.zeros((len(unary), 2))
        now = np.zeros((count, 2))
        for t in range(longest):
            k = active[t]
            if t:
                now = np.logaddexp(now[:k, :1] + self.pairs[0], now[:k, 1:] + self.pairs[1])
            else:
                now = np.zeros((k, 2))
            now[:, 1] += unary[starts[:k] + t]
            forward[starts[:k] + t] = now
        expected = np.zeros((2, 2))
        later = np.zeros((0, 2))
        for t in range(longest - 1, -1, -1):
            k = active[t]
            here = np.zeros((k, 2))
            if len(later):
                m = len(later)
                follow = later.copy()
                follow[:, 1] += unary[starts[:m] + t + 1]
                step = self.pairs[None] + follow[:, None, :]
                here[:m] = np.logaddexp(step[:, :, 0], step[:, :, 1])
                if with_pairs:
                    joint = forward[starts[:m] + t][:, :, None] + step
                    total = np.logaddexp.reduce(joint.reshape(m, 4), axis=1)
                    expected += np.exp(joint - total[:, None, None]).sum(axis=0)
            back[starts[:k] + t] = here
            later = here
        difference = (forward + back)[:, 1] - (forward + back)[:, 0]
        good = 1 / (1 + np.exp(-np.clip(difference, -500, 500)))
        return (good, expected) if with_pairs else good

    def scores(self, texts: list[bytes | None]) -> list[float]:
        """Length-weighted mean of the lines' chances; 0 for a text without anything but white space."""
        found = [text_features(t) for t in texts if t and not t.isspace()]
        if not found:
            return [0.0] * len(texts)
        lengths = np.array([len(w) for _, w in found])
        good = self.marginals(self.unary(np.concatenate([f for f, _ in found])), lengths)
        weights = np.concatenate([w for _, w in found])
        starts = np.cumsum(lengths) - lengths
        means = np.add.reduceat(good * weights, starts) / np.add.reduceat(weights, starts)
        values = iter(np.clip(means, 0, 1).tolist())
        return [next(values) if t and not t.isspace() else 0.0 for t in texts]


def fit(documents: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> LineChain:
    """Maximise the penalised likelihood of documents (features of their lines, label of all their lines)."""
    width = OWN + 2 * (BESIDE + 1)
    if len({label for _, label in documents}) < 2:
        # Nothing to tell apart: the chance is one half, or near the only label there is.
        lean = 0.0 if not documents else 4.0 * (2 * documents[0][1] - 1)
        weights = np.zeros(width + 1)
        weights[-1] = lean
        return LineChain(weights, np.zeros((2, 2)), np.zeros(width), np.ones(width))
    features = np.concatenate([f for f, _ in documents]).astype(np.float64)
    lengths = np.array([len(f) for f, _ in documents])
    labels = np.array([label for _, label in documents])
    gold = np.repeat(labels, lengths)
    model = LineChain(np.zeros(width + 1), np.zeros((2, 2)), features.mean(axis=0), features.std(axis=0) + 1e-6)
    scaled = (features - model.mean) / model.spread
    repeats = np.zeros((2, 2))
    for label in (0, 1):
        repeats[label, label] = (lengths[labels == label] - 1).sum()
    values = np.concatenate([model.weights, model.pairs.ravel()])
    first, second = np.zeros_like(values), np.zeros_like(values)
    for epoch in range(1, epochs + 1):
        model.weights, model.pairs = values[: width + 1], values[width + 1 :].reshape(2, 2)
        good, expected = model.marginals(scaled @ model.weights[:-1] + model.weights[-1], lengths, with_pairs=True)
        miss = good - gold
        slope = np.concatenate([scaled.T @ miss, [miss.sum()], (expected - repeats).ravel()]) / len(gold) + PENALTY * values
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        values = values - STEP * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    model.weights, model.pairs = values[: width + 1], values[width + 1 :].reshape(2, 2)
    return model


def train(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    held_out: tuple[int, int] = (3, 1),
    sample: int = SAMPLE_DOCUMENTS,
    total_lines: int = SAMPLE_TOTAL_LINES,
) -> LineChain:
    """Fit the line chain on a bounded sample of labelled documents.

    The sample holds the `sample` labelled ids with the smallest hash outside the held-out fold (modulus,
    remainder of crc32); documents without content are not learnt from, null ids are never sampled. Of an id with several rows
    the text with the smallest hash is taken, once. In the order of their ids' hash, documents are learnt from as
    long as `total_lines` lines hold them; one that does not fit, whatever its length, makes room for the next. An
    id with several labels takes the lowest. Without labels of both kinds the model leans to the only one, or is undecided.
    """
    modulus, remainder = held_out
    known = (
        labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{quality}`").alias("_good"))
        .where(F.col("_good").isNotNull() & (fold(F.col("_id"), modulus) != remainder))
        .groupBy("_id").agg(F.min("_good").alias("_good"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    rows = documents.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(known), "_id")
    lines = F.size(F.split("_text", "\n"))
    rows = rows.where(F.col("_text").rlike(r"[^ \t\n\r\x0B\f]"))
    # One row of an id leaves each task, however often the id is repeated.
    one = rows.groupBy("_id", "_good").agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"))
    one = stored(one.select("_id", "_good", "_text", F.xxhash64("_id").alias("_hash"), lines.cast("bigint").alias("_lines")), "quality-sample")
    chosen, taken = [], 0
    for row in sorted(one.select("_hash", "_lines").collect()):  # at most `sample`
        if taken + row["_lines"] <= total_lines:
            taken += row["_lines"]
            chosen.append(row["_hash"])
    rows = one.where(F.col("_hash").isin(chosen)) if chosen else one.limit(0)

    def make():
        def compute(texts):
            return [[text_features(t)[0].tobytes() if t and not t.isspace() else None for t in texts]]

        return compute

    found = map_texts(rows, "_text", "features binary", make, ["_id", "_good"]).where(F.col("features").isNotNull())
    width = OWN + 2 * (BESIDE + 1)
    sampled = sorted(((r["_id"], bytes(r["features"]), r["_good"]) for r in found.toLocalIterator()), key=lambda r: (str(r[0]), r[1]))
    return fit([(np.frombuffer(f, np.float32).reshape(-1, width), int(good)) for _, f, good in sampled])


def with_quality(documents: DataFrame, model: LineChain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `quality_score` to every row from its whole text.

    0 to 1, higher is better; null texts and texts of white space score 0. Lines end at line feeds, and all lines of a text
    count, however many there are. Null ids do not matter. Equal texts get equal scores; an empty table stays empty. A
    column of the result's name is replaced, others stay.
    """
    return map_texts(documents, text, "quality_score double", lambda: lambda texts: [model.scores(texts)], keep)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model that has not seen the held-out fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = with_quality(documents, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
