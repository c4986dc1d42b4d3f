"""Result writers. Nothing is collected: rows go from the executors to the files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillsight.plans.attach import attach_one_row


def write_table(
    df: DataFrame, path: str, *, partition_by: Sequence[str] = (), file_format: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write a table; an existing one is left alone unless `mode` says to append or overwrite."""
    writer = df.write.mode(mode).format(file_format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_run(df: DataFrame, path: str, run: str, *, file_format: str = "parquet") -> None:
    """Write the rows of one run under `run=<name>`; a run that is written again replaces its own rows only.

    The files are staged beside the table and moved into the run's folder when the job commits. A job that ends before
    that leaves the table as it was.
    """
    staged = df.withColumn("run", F.lit(run)).write.mode("overwrite").format(file_format)
    staged.option("partitionOverwriteMode", "dynamic").partitionBy("run").save(path)


def write_scores(
    task: str, predictions: DataFrame, path: str, metric: Callable[[DataFrame], DataFrame | None] | None = None,
    *, mode: str = "errorifexists", run: str | None = None,
) -> DataFrame:
    """Write a scoring run; return its one-row summary: task, row_count and the columns of the metric.

    `metric` turns the written rows into a one-row table, e.g. `quality.churn_accuracy`. Count and
    metric are taken from the written rows, so the scores are computed once. With `run` the rows are kept under that
    name, and writing the run again replaces them (`write_run`); `mode` is for tables without runs.
    """
    spark = predictions.sparkSession
    if run is None:
        write_table(predictions, path, mode=mode)
        written = spark.read.schema(predictions.schema).parquet(path)
    else:
        write_run(predictions, path, run)
        kept = StructType([*predictions.schema.fields, StructField("run", StringType())])
        written = spark.read.schema(kept).parquet(path).where(F.col("run") == run).drop("run")
    summary = written.agg(F.count("*").alias("row_count")).select(F.lit(task).alias("task"), "row_count")
    measured = metric(written) if metric else None
    return summary if measured is None else attach_one_row(summary, measured)
