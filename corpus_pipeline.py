"""From raw documents to token ids: five stages, each one operator over all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import bpe, decontaminate, lines, quality, simhash
from tillsight.llm.common import table
from tillsight.plans.shared import settled
from tillsight.session import size_shuffles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line chain scores at one half or more; the model learns outside the held-out fold.

    A null or empty text is scored like any other; equal rows fare alike. No row is changed, an empty table stays empty.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_quality(docs, model).where("quality_score >= 0.5").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier line; `n_chars` follows the text.

    A null text stays null (with null `n_chars`), a text that loses all its lines stays as an empty one. Rows equal in id and
    text keep the same lines.
    """
    return lines.remove_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Null and empty texts have one fingerprint, so one of them stays. Of rows that share the id one stays.
    """
    return simhash.keep_one(docs).select(COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit less than one word in twenty.

    Texts without words are clean; without a benchmark all are.
    """
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining texts, with digests of the ids and of the text decoded from them; a null text has no ids."""
    results = f"ids array<int>, {bpe.DIGESTS}"
    return bpe.tokenize(docs.select("doc_id", "text"), results=results, derive=bpe.ids_and_digests, keep=["doc_id"])


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_first),
    ("decontamination", keep_uncontaminated),
    ("bpe", encode),
]

#: A trained model, hashes of shingles and a tokenizer's vocabulary are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written to the shared folder and read by the next.

    What a stage writes on its way is deleted when its result is there. Rows without id or text go through all stages, repeated
    rows as often as they occur where no stage names one of them; an empty table gives an empty result.
    """
    size_shuffles(spark, f"{sf_dir}/documents.parquet")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
