"""Registered queries of the subpackage and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillsight.llm import bpe, centroids, decontaminate, divergence, embeddings, language, licenses, lines, quality, scoring, sharding, simhash, warc
from tillsight.session import size_shuffles

Query = Callable[[SparkSession, str], DataFrame]


def _sized(run: Query) -> Query:
    """The query with as many shuffle partitions as its input folder asks for."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        size_shuffles(spark, sf_dir)
        return run(spark, sf_dir)

    return query


_RUNS: dict[str, Query] = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality": quality.op4_quality,
    "op5_language": language.op5_language,
    "op6_simhash": simhash.op6_simhash,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_embedding_dedup": embeddings.op8_embedding_dedup,
    "op9_lm_score": scoring.op9_lm_score,
    "op10_sharding": sharding.op10_sharding,
    "op11_divergence": divergence.op11_divergence,
    "op12_warc": warc.op12_warc,
    "op13_centroids": centroids.op13_centroids,
}

QUERIES = {name: _sized(run) for name, run in _RUNS.items()}

ORACLES = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op2_line_dedup": lines.OP2_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op8_embedding_dedup": embeddings.OP8_SQL,
    "op10_sharding": sharding.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
