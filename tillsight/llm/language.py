"""Language of a text from averaged embeddings of hashed subwords under a linear softmax.

A text is the mean of the embeddings of the byte n-grams of its words; a linear layer turns it into one value per language.
Both are trained together by stochastic gradient descent. A temperature fitted on documents left out of the training
calibrates the probabilities, and those below a threshold from the same documents are rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillsight.llm.common import fold, map_texts, table
from tillsight.plans.shared import stored

BUCKETS = 1 << 15
WIDTH = 16
SIZES = (2, 3, 4)
#: Distinct texts a language is learnt from, about (never more than twice as many), and bytes of n-gram counts in the whole sample.
SAMPLE_PER_LANGUAGE = 800
SAMPLE_BYTES = 128 << 20
EPOCHS = 8
RATE = 0.5
DECAY = 1e-4
#: Most a bucket's step is scaled up, and the n-grams of a fragment (least, most).
SCALE = 30
FRAGMENT = (4, 200)
#: Share of the sample kept for calibration, and the share of its right answers that must stay accepted.
CALIBRATION = 0.2
ACCEPTED = 0.99
#: Bytes turned into n-grams at once.
CHUNK = 1 << 19

UNKNOWN = "und"
# Letters a-z and bytes beyond ASCII stay, A-Z become lower case, the rest separates words.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LATIN = re.compile(rb"[A-Za-z]")
_MIX = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA6B), 4: np.uint32(0xC2B2AE35)}


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return not text.isspace() and (_LATIN.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace"))))


def subwords(text: bytes):
    """Buckets of the n-grams of the words, each word between spaces; long texts come in several arrays."""
    spaced = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    whole = np.frombuffer(spaced, np.uint8)
    for start in range(0, len(whole), CHUNK):
        part = whole[start : start + CHUNK + max(SIZES) - 1].astype(np.uint32)
        space = part == 0x20
        for size in SIZES:
            count = min(len(part) - size + 1, CHUNK)
            if count <= 0:
                continue
            code, inside = np.zeros(count, np.uint32), np.ones(count, bool)
            for k in range(size):
                code = code * np.uint32(257) + part[k : k + count]
                if 0 < k < size - 1:
                    inside &= ~space[k : k + count]
            if size == 2:
                inside &= ~(space[:count] & space[1 : 1 + count])
            mixed = code * _MIX[size]
            yield (mixed[inside] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))  # what a bucket adds to each language
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    threshold: float = 0.0

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether that is enough to accept it."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        total, count = np.zeros(len(self.languages)), 0
        for buckets in subwords(text):
            total += self.values[buckets].sum(axis=0, dtype=np.float64)
            count += len(buckets)
        chances = softmax((total / max(count, 1) + self.bias) / self.temperature)
        best = int(chances.argmax())
        score = float(chances[best])
        return self.languages[best], score, score >= self.threshold


def softmax(values: np.ndarray) -> np.ndarray:
    powers = np.exp(values - values.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = EPOCHS) -> LanguageModel:
    """Train on (distinct buckets, how often, language) of documents, in an order drawn with a fixed seed."""
    languages = sorted({language for *_, language in samples})
    if not languages:
        return LanguageModel()
    number = {language: i for i, language in enumerate(languages)}
    draw = np.random.default_rng(7)
    order = draw.permutation(len(samples))
    held = order[: int(len(samples) * CALIBRATION)]
    learnt = order[len(held) :]
    embeddings = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    shares = np.bincount([number[samples[i][2]] for i in learnt], minlength=len(languages))
    weight = np.minimum(len(learnt) / (len(languages) * np.maximum(shares, 1)), 10)
    steps = max(1, epochs * len(learnt))
    for step in range(epochs * len(learnt)):
        sample = samples[learnt[step % len(learnt)]]
        buckets, counts, language = sample if step % 2 else fragment(sample, draw)
        rate = RATE * (1 - step / steps)
        part = counts / counts.sum()
        mean = part @ embeddings[buckets]
        miss = softmax(mean @ layer + bias)
        goal = number[language]
        miss[goal] -= 1
        miss *= weight[goal]
        back = layer @ miss
        layer -= rate * (np.outer(mean, miss) + DECAY * layer)
        bias -= rate * 0.1 * miss
        # A bucket's share of a mean is small; the step is scaled up towards what a single n-gram would get.
        embeddings[buckets] -= np.outer(np.minimum(part * SCALE, 1) * rate, back)
    model = LanguageModel(languages, (embeddings @ layer).astype(np.float32), bias)
    tested = [samples[i] for i in held]
    return calibrate(model, tested + [fragment(sample, draw) for sample in tested for _ in range(4)], number)


def fragment(sample: tuple[np.ndarray, np.ndarray, str], draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray, str]:
    """A few n-grams of a document, as a short text would have."""
    buckets, counts, language = sample
    size = int(np.exp(draw.uniform(*np.log(FRAGMENT))))
    picked, often = np.unique(draw.choice(buckets, size, p=counts / counts.sum()), return_counts=True)
    return picked, often.astype(np.float64), language


def calibrate(model: LanguageModel, held: list[tuple[np.ndarray, np.ndarray, str]], number: dict[str, int]) -> LanguageModel:
    if not held:
        return model
    values = np.array([(c[:, None] * model.values[b]).sum(axis=0) / c.sum() + model.bias for b, c, _ in held])
    goal = np.array([number[language] for *_, language in held])
    tried = np.exp(np.linspace(-3, 3, 61))
    losses = [-np.log(softmax(values / t)[np.arange(len(goal)), goal] + 1e-12).mean() for t in tried]
    model.temperature = float(tried[int(np.argmin(losses))])
    chances = softmax(values / model.temperature)
    right = np.sort(chances.max(axis=1)[chances.argmax(axis=1) == goal])
    if len(right):
        model.threshold = float(right[int(len(right) * (1 - ACCEPTED))])
    return model


def train(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    held_out: tuple[int, int] = (5, 0),
    per_language: int = SAMPLE_PER_LANGUAGE,
    most_bytes: int = SAMPLE_BYTES,
) -> LanguageModel:
    """Fit on a bounded sample outside the held-out fold (modulus, remainder of crc32 of the id).

    A text that is repeated within a language counts once. Distinct texts are counted per language, and about `per_language` of
    each, at most twice as many, are drawn by the smallest hashes of their texts, whatever the other languages have. Of the
    n-gram counts made from them each language brings at most its share of `most_bytes` to the driver, one text at
    least. Rows without id, language or letters are not learnt from. Without any row the model knows no language and
    answers `und`.
    """
    modulus, remainder = held_out
    rows = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("id"), modulus) != remainder))
    rows = rows.withColumn("hash", F.xxhash64("text")).select("lang", "hash", "text")
    # One row per language: the share of hashes that holds about the wanted number of distinct texts.
    shares = rows.groupBy("lang").agg((F.lit(1.25 * per_language) / F.approx_count_distinct("hash")).alias("share"))
    shares = stored(shares, "language-shares")
    place = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    once = rows.join(shares, "lang").where(place < F.col("share")).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    by_hash = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash")
    drawn = once.withColumn("number", F.row_number().over(by_hash)).where(F.col("number") <= 2 * per_language)

    def make():
        def compute(texts):
            found = []
            for value in texts:
                if not has_letter(value):
                    found.append(None)
                    continue
                counts = np.zeros(BUCKETS, np.int64)
                for buckets in subwords(value):
                    counts += np.bincount(buckets, minlength=BUCKETS)
                used = np.flatnonzero(counts)
                found.append(np.stack([used, counts[used]]).astype(np.uint32).tobytes())
            return [found]

        return compute

    found = stored(map_texts(drawn, "text", "buckets binary", make, ["lang", "number"]).where("buckets is not null"), "language-sample")
    languages = found.select("lang").distinct().count()
    held = F.sum(F.octet_length("buckets").cast("bigint")).over(Window.partitionBy("lang").orderBy("number"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("number")) == 1
    sent = found.withColumns({"held": held, "first": first}).where((F.col("held") * max(languages, 1) <= most_bytes) | F.col("first"))
    sample = []
    for row in sorted(sent.select("lang", "number", "buckets").collect()):
        used, often = np.frombuffer(bytes(row["buckets"]), np.uint32).reshape(2, -1)
        sample.append((used.astype(np.int64), often.astype(np.float64), row["lang"]))
    return fit(sample)


def with_language(documents: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `lang_pred`, `lang_score` and `lang_accepted` to every row from its whole text.

    A null text or one without a letter is `und` with score 0, not accepted. Ties go to the language that sorts
    first. Equal texts get equal answers; an empty table stays empty. Columns named like a result are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        return lambda texts: [list(column) for column in zip(*map(known.predict, texts))]

    return map_texts(documents, text, "lang_pred string, lang_score double, lang_accepted boolean", make, keep)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model that has not seen the held-out fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(documents)
    return with_language(documents.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_accepted").alias("accepted"),
    )
