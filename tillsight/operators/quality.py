"""Offline quality metrics over scored tables that kept their label column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillsight import fixed_values as fv
from tillsight.functions.numeric import rounded
from tillsight.operators.churn import churn_score
from tillsight.operators.reviews import review_sentiment
from tillsight.operators.risk import event_anomalies
from tillsight.plans.attach import all_present, grouped


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: share of rows with prediction equal to label (4 decimals; 0 without rows) and sample_size."""
    hit = F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("int")
    return df.agg(
        F.coalesce(rounded(F.avg(hit), 4), F.lit(0.0)).alias("accuracy"), F.count("*").alias("sample_size")
    )


def churn_accuracy(scored: DataFrame, churned: str = "churned") -> DataFrame:
    """Accuracy of the risk level, with medium taken as high, against the churned flag."""
    compared = scored.select(
        F.when(F.col(churned) == 1, "high").otherwise("low").alias("label"),
        F.when(F.col("risk_level") == "medium", "high").otherwise(F.col("risk_level")).alias("prediction"),
    )
    return accuracy(compared, "label", "prediction")


def top_scored(df: DataFrame, score: str, k: int, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """The k rows with the highest score, of every group where there are keys; equal scores in order of `tie`.

    Only the k best rows of a group in each task are shuffled, also of a group that holds most rows.
    """
    order = [F.col(score).desc(), F.col(tie).asc()]
    if not keys:
        return df.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return all_present(df, keys).withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def precision_at_k(df: DataFrame, label: str, score: str, k: int, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of positive labels (0/1) among the k best scores: one row, 0 without rows or with k <= 0.

    With keys one row per group, by the k best of the group; null keys form none.
    """
    best = top_scored(df.select(*keys, label, score, tie), score, max(k, 0), tie, keys)
    if keys and k <= 0:
        best = all_present(df, keys).select(*keys, F.lit(None).cast("int").alias(label))
    counted = grouped(
        best, keys, F.coalesce(rounded(F.avg(label), 4), F.lit(0.0)).alias("precision_at_k"), F.count("*").alias("ranked_count")
    )
    return counted.withColumn("ranked_count", F.lit(0).cast("bigint")) if keys and k <= 0 else counted


def metric_record(
    metric: DataFrame, task: str, version: str, metric_name: str, value: str, sample_size: str | Column
) -> DataFrame:
    """A one-row metric table as a record of the metric log."""
    size = F.col(sample_size) if isinstance(sample_size, str) else sample_size
    return metric.select(
        F.lit(task).alias("task"),
        F.lit(version).alias("version"),
        F.lit(metric_name).alias("metric_name"),
        rounded(F.col(value), 4).alias("metric_value"),
        size.cast("bigint").alias("sample_size"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("created_at"),
    )


def evaluate(
    reviews: DataFrame,
    customers: DataFrame,
    events: DataFrame,
    version: str,
    k: int = 2,
    *,
    positive: Sequence[str] = fv.POSITIVE_KEYWORDS,
    negative: Sequence[str] = fv.NEGATIVE_KEYWORDS,
) -> DataFrame:
    """The three quality metrics of a run as metric-log records, from normalised labelled tables."""
    scored = review_sentiment(reviews, positive=positive, negative=negative)
    sentiment = accuracy(scored, "sentiment_label", "sentiment")
    churn = churn_accuracy(churn_score(customers))
    precision = precision_at_k(event_anomalies(events), "is_anomaly", "anomaly_probability", k, "event_id")
    sized = precision.withColumn("sample_size", events.agg(F.count("*").alias("n")).scalar())
    records = [
        metric_record(sentiment, "review_sentiment", version, "accuracy", "accuracy", "sample_size"),
        metric_record(churn, "churn", version, "accuracy_proxy", "accuracy", "sample_size"),
        metric_record(sized, "anomaly", version, f"precision_at_{k}", "precision_at_k", "sample_size"),
    ]
    return reduce(DataFrame.unionByName, records)
