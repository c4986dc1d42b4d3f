"""Language-model scores of documents.

A log-bilinear model gives the chance of a token's class after the class of the token before it: both classes have a vector, learnt
with noise-contrastive estimation on the counts of all neighbouring pairs, and batched products of the vectors are
normalised over all classes. Within its class a token has its share of the count, and tokens never seen have a share that
follows from the tokens seen once. The most frequent tokens are classes of their own, the others go by their endings; the number
of classes grows with the root of the vocabulary, so the table of pairs never outgrows it.

Counts of tokens stay a table: texts are dealt into pieces, each piece asks for the counts of its distinct tokens, and the
answers meet the texts again by piece. No task and not the driver holds the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillsight.llm.common import fold, pieces, table
from tillsight.plans.shared import stored

#: Bytes of text of a piece; a longer text is a piece of its own.
PIECE = 8 << 20
#: Classes: the root of the number of distinct tokens within these bounds; OTHERS of them take tokens by their last byte.
LEAST_CLASSES, MOST_CLASSES = 64, 2048
OTHERS = 16
ENDING = 3
WIDTH = 24
NOISE = 8
EPOCHS = 150
RATE = 0.05
SEED = 42
#: Unseen tokens of a class count at least as much as this part of one token.
LEAST_UNSEEN = 0.5

END = b""
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words between white space (A-Z lower-cased), then the end."""
    tokens = text.translate(_LOWER).split() if text else []
    tokens.append(END)
    return tokens


def numbered(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens of texts, all tokens as places among them, and how many each text has."""
    seen: dict[bytes, int] = {END: 0}
    sizes, line = [], []
    for text in texts:
        tokens = tokens_of(text)
        sizes.append(len(tokens))
        line += [seen.setdefault(t, len(seen)) for t in tokens]
    return list(seen), np.array(line, np.int64), np.array(sizes, np.int64)


def after_ends(line: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The token before each one; texts start after an end."""
    before = np.empty_like(line)
    before[1:] = line[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before


def hashes_of(tokens: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t, SEED) for t in tokens], np.uint64).view(np.int64)


def endings_of(tokens: list[bytes]) -> np.ndarray:
    """The last bytes of each token as a number; the empty token has 0."""
    return np.array([int.from_bytes(t[-ENDING:]) for t in tokens], np.int64)


def dealt(documents: DataFrame, doc_id: str, text: str, held_out: tuple[int, int]) -> DataFrame:
    """`piece`, `doc_id`, `held` (null where the id is), `text`: every row in a piece of bounded text, stored."""
    modulus, remainder = held_out
    value = F.col(f"`{doc_id}`")
    rows = documents.select(value.alias("doc_id"), (fold(value, modulus) == remainder).alias("held"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part, _ in pieces(batch, 2):
                numbers = pa.array(np.full(part.num_rows, piece, np.int64))
                yield pa.RecordBatch.from_arrays([numbers, *part.columns], names=["piece", "doc_id", "held", "text"])
                filled += pc.sum(pc.binary_length(part.column(2))).as_py() or 0
                if filled >= PIECE:
                    piece, filled = piece + 1, 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"piece bigint, doc_id {kind}, held boolean, text string"), "dealt-texts")


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes | None], np.ndarray]]:
    """Piece, texts and learnt-from flags of each stretch of rows of one piece."""
    for batch in batches:
        for part, texts in pieces(batch, batch.num_columns - 1):
            numbers = part.column("piece").to_numpy()
            learnt = pc.fill_null(pc.invert(part.column("held")), False).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield int(numbers[a]), texts[a:b], learnt[a:b]


def counted_tokens(texts: DataFrame) -> DataFrame:
    """`piece`, `hash`, `ending`, `own` (occurrences there in texts learnt from), `total` (over all), `first`, stored.

    A row for each distinct token of a piece, so no token has more rows than there are pieces; the totals come by a window
    over the tokens, with one exchange. `first` marks one row of each token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, values, learnt in _by_piece(batches):
            tokens, line, sizes = numbered(values)
            weights = np.repeat(learnt, sizes)
            own = np.bincount(line, weights, minlength=len(tokens)).astype(np.int64)
            columns = [np.full(len(tokens), piece, np.int64), hashes_of(tokens), endings_of(tokens).astype(np.int32), own]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["piece", "hash", "ending", "own"])

    rows = texts.select("piece", "held", "text").mapInArrow(run, "piece bigint, hash bigint, ending int, own bigint")
    token = Window.partitionBy("hash")
    found = rows.withColumns({"total": F.sum("own").over(token), "first": F.row_number().over(token.orderBy("piece")) == 1})
    return stored(found, "token-counts")


@dataclass
class Classes:
    """Which class a token belongs to: one of its own by hash, else by its ending, else by its last byte. Size: the classes."""

    own: np.ndarray  # hashes, sorted
    endings: np.ndarray  # sorted

    @property
    def count(self) -> int:
        return len(self.own) + len(self.endings) + OTHERS

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        found = len(self.own) + len(self.endings) + (endings & (OTHERS - 1))
        for known, values, start in ((self.endings, endings, len(self.own)), (self.own, hashes, 0)):
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                found = np.where(known[at] == values, start + at, found)
        return found


def classes_of(counts: DataFrame, distinct: int, learnt: int) -> Classes:
    """Half of the classes are the most frequent tokens (seen twice at least), half the most frequent endings of the others."""
    wanted = int(np.clip(np.sqrt(distinct), LEAST_CLASSES, MOST_CLASSES)) - OTHERS
    seen = counts.where("first and total > 0")
    end = int(hashes_of([END])[0])
    often = [r["hash"] for r in seen.where("total > 1").orderBy(F.desc("total"), "hash").select("hash").limit(wanted // 2).collect()]
    own = np.array(sorted({*often, end} if learnt else set()), np.int64)
    rest = seen.where(~F.col("hash").isin(own.tolist())) if len(own) else seen
    most = rest.groupBy("ending").agg(F.sum("total").alias("n")).orderBy(F.desc("n"), "ending").limit(wanted - wanted // 2)
    return Classes(own, np.array(sorted(r["ending"] for r in most.collect()), np.int64))


def class_pairs(texts: DataFrame, classes: Classes) -> np.ndarray:
    """How often each class follows each (rows: the one before) in the texts learnt from."""
    size = classes.count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size * size, np.int64)
        for _, values, learnt in _by_piece(batches):
            tokens, line, sizes = numbered([v for v, l in zip(values, learnt, strict=True) if l])
            if len(line):
                own = classes.of(hashes_of(tokens), endings_of(tokens))
                after = own[line]
                np.add.at(cells, after_ends(after, sizes, own[0]) * size + after, 1)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(cells[used])], names=["cell", "n"])

    found = texts.select("piece", "held", "text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    arrow = found.toArrow()  # at most MOST_CLASSES squared
    total = np.zeros(size * size)
    total[arrow.column("cell").to_numpy()] = arrow.column("n").to_numpy()
    return total.reshape(size, size)


def train_classes(pairs: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Natural-log chances (row: class before), normalised over all classes, of a log-bilinear model trained against noise.

    The noise is the classes' own distribution, NOISE draws for each pair seen; as all pairs are counted, their
    expectation stands in for single draws. Without any pair all classes are equally likely.
    """
    contexts, targets, bias = class_vectors(pairs, epochs)
    scores = (contexts @ targets.T + bias).astype(np.float64)
    most = scores.max(axis=1, keepdims=True)
    return scores - most - np.log(np.exp(scores - most).sum(axis=1, keepdims=True))


def class_vectors(pairs: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of the class before and after and the bias, as `train_classes` learns them."""
    total = pairs.sum()
    draw = np.random.default_rng(11)
    contexts, targets = (draw.normal(0, 0.1, (len(pairs), WIDTH)).astype(np.float32) for _ in range(2))
    noise = (pairs.sum(axis=0) + 1) / (total + len(pairs))
    bias = np.log(noise).astype(np.float32)
    if total:
        seen = (pairs / total).astype(np.float32)
        drawn = (NOISE * pairs.sum(axis=1, keepdims=True) / total * noise).astype(np.float32)
        border = np.log(NOISE * noise).astype(np.float32)
        values = [contexts, targets, bias]
        moments = [[np.zeros_like(v), np.zeros_like(v)] for v in values]
        for epoch in range(1, epochs + 1):
            slope = np.clip(contexts @ targets.T + bias, -60, 60)
            slope = 1 / (1 + np.exp(border - slope))  # chance that a pair was seen
            slope *= drawn + seen
            slope -= seen  # of the loss, by the score of each pair: drawn * chance - seen * (1 - chance)
            for value, (first, second), gradient in zip(values, moments, (slope @ targets, slope.T @ contexts, slope.sum(axis=0))):
                first += 0.1 * (gradient - first)
                second += 0.01 * (gradient**2 - second)
                value -= (RATE * (1 - epoch / (epochs + 1)) * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-9)).astype(np.float32)
    return contexts, targets, bias


@dataclass
class ClassModel:
    """What a task needs to score a piece beside the counts of its tokens; its size follows the number of classes."""

    classes: Classes
    chances: np.ndarray  # log10, class before by class
    sizes: np.ndarray  # tokens learnt from, by class
    unseen: np.ndarray  # what the unseen tokens of a class count together
    tokens: int
    distinct: int

    def shares(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a token's chance within its class; an unseen token has the chance of all unseen ones of the class."""
        whole = self.sizes + self.unseen
        return np.log10(np.where(counts > 0, counts, self.unseen[classes]) / whole[classes])

    def score(self, texts: list[bytes | None], hashes: np.ndarray, totals: np.ndarray) -> list[np.ndarray]:
        """Tokens, known tokens, base and model score of each text; `hashes` are sorted and hold all tokens of the texts."""
        tokens, line, sizes = numbered(texts)
        own = hashes_of(tokens)
        counts = totals[np.searchsorted(hashes, own)]
        classes = self.classes.of(own, endings_of(tokens))
        base = np.log10(counts + 1) - np.log10(self.tokens + self.distinct + 1)
        inside = self.shares(classes, counts)
        after = classes[line]
        model = self.chances[after_ends(after, sizes, classes[0]), after] + inside[line]
        starts = np.cumsum(sizes) - sizes
        return [sizes, *(np.add.reduceat(v, starts) for v in ((counts > 0).astype(np.int64)[line], base[line], model))]


def unseen_counts(counts: DataFrame, classes: Classes) -> np.ndarray:
    """Tokens seen once, by class: they stand for those not seen. A class of one token has no others."""
    once = counts.where("total = 1 and own = 1").groupBy("ending").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes.count, np.int64)
        for batch in batches:
            endings = batch.column(0).to_numpy().astype(np.int64)
            # Tokens with classes of their own are seen twice at least, but for the end, whose ending no other token has.
            np.add.at(total, classes.of(np.zeros(len(endings), np.int64), endings), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["class", "n"])

    found = np.zeros(classes.count)
    for row in once.mapInArrow(run, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect():
        found[row["class"]] = row["n"]
    found = np.maximum(found, LEAST_UNSEEN)
    found[: len(classes.own)] = 0
    return found


def train(texts: DataFrame, counts: DataFrame) -> ClassModel:
    """The model from the dealt texts and their counted tokens."""
    seen = F.col("total") > 0
    row = counts.agg(F.sum("own"), F.count_if(F.col("first") & seen)).first()
    tokens, distinct = row[0] or 0, row[1] or 0
    classes = classes_of(counts, distinct, tokens)
    pairs = class_pairs(texts, classes)
    chances = (train_classes(pairs) / np.log(10)).astype(np.float32)
    return ClassModel(classes, chances, pairs.sum(axis=0), unseen_counts(counts, classes), tokens, distinct)


PARTS = "n_tokens bigint, n_known bigint, base_score double, score double"


def score_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (7, 2)) -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of every row.

    Learns from the rows outside the held-out fold (modulus, remainder of crc32 of the id). `base_score` is the sum of
    log10((c+1)/(N+V+1)) over the tokens, `score` the log10 chance of the text under the model; a token not
    seen in training has the chance of all unseen tokens of its class. A null or empty text has one token, the end.
    A row without id is neither learnt from nor held out. Repeated rows count as often as they occur. A very long text is
    a piece of its own. Only the two columns named are read; an empty table gives an empty result. Tokens are told apart by
    64-bit hashes. What the driver holds is bounded by MOST_CLASSES squared.
    """
    texts = dealt(documents, doc_id, text, held_out)
    counts = counted_tokens(texts)
    model = train(texts, counts)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], k) for n, k in (("doc_id", rows.schema.field("doc_id").type), *NUMBERS)})
        hashes, at = np.unique(known.column("hash").to_numpy(), return_index=True)
        totals = known.column("total").to_numpy()[at]
        values = rows.column("text").combine_chunks().cast(pa.binary()).to_pylist()
        found = shared.value.score(values, hashes, totals)
        held = pc.fill_null(rows.column("held"), False)
        columns = [pa.array(v.astype(t.to_pandas_dtype())) for v, (_, t) in zip(found, NUMBERS[1:], strict=True)]
        return pa.table([rows.column("doc_id"), held, *columns], names=["doc_id", *(n for n, _ in NUMBERS)])

    scored = texts.groupBy("piece").cogroup(counts.select("piece", "hash", "total").groupBy("piece")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, {PARTS}"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


NUMBERS = [("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and scores of every document."""
    return score_documents(table(spark, sf_dir, "documents"))
