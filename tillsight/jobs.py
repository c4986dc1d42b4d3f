"""Batch jobs over the CSV datasets: score, evaluate, profile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tillsight.operators import quality
from tillsight.operators.churn import churn_score
from tillsight.operators.menu import menu_pricing
from tillsight.operators.normalize import normalize
from tillsight.operators.operations import inventory_reorder, staffing_gaps
from tillsight.operators.profile import profile_all
from tillsight.operators.reviews import review_sentiment
from tillsight.operators.risk import event_anomalies
from tillsight.operators.sales import sales_factors
from tillsight.plans.shared import stored
from tillsight.sources import append_metrics, read_raw, write_scores

# Task name per dataset.
TASKS = {
    "sales": "sales_factor_baseline",
    "customer": "churn_baseline",
    "review": "review_sentiment_baseline",
    "anomaly": "anomaly_baseline",
    "menu": "menu_strategy_baseline",
    "inventory": "inventory_baseline",
    "staffing": "staffing_baseline",
}
SCORERS = {
    "sales": sales_factors,
    "customer": churn_score,
    "review": review_sentiment,
    "anomaly": event_anomalies,
    "menu": menu_pricing,
    "inventory": inventory_reorder,
    "staffing": staffing_gaps,
}


def load(spark: SparkSession, dataset: str, path: str, mode: str = "strict") -> DataFrame:
    """CSV files of a dataset, normalised."""
    return normalize(read_raw(spark, dataset, path), dataset, mode)


def metric(dataset: str, scored: DataFrame, k: int = 2) -> DataFrame | None:
    """The dataset's quality metric on its scored rows, for the three labelled datasets."""
    if dataset == "customer":
        return quality.churn_accuracy(scored)
    if dataset == "review":
        return quality.accuracy(scored, "sentiment_label", "sentiment")
    if dataset == "anomaly":
        return quality.precision_at_k(scored, "is_anomaly", "anomaly_probability", k, "event_id")
    return None


def score(spark: SparkSession, dataset: str, path: str, output: str, run: str | None = None) -> DataFrame:
    """Score the CSV files at `path`, write the rows to `output`, return the one-row summary.

    With `run` the job can be run again: the rows of the run are replaced.
    """
    scored = SCORERS[dataset](load(spark, dataset, path))
    return write_scores(TASKS[dataset], scored, output, lambda written: metric(dataset, written), run=run)


def evaluate(
    spark: SparkSession, paths: Mapping[str, str], registry: str, version: str = "baseline-0.1.0", run: str | None = None
) -> DataFrame:
    """Evaluate the labelled datasets (review, customer, anomaly), add the metrics to the log under `run`, return them."""
    tables = [load(spark, name, paths[name]) for name in ("review", "customer", "anomaly")]
    records = stored(quality.evaluate(*tables, version), "metrics")
    append_metrics(records, registry, run)
    return records


def profile_files(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Profiles of the given datasets, dataset name to CSV path."""
    return profile_all({name: read_raw(spark, name, path) for name, path in paths.items()})
