"""Metric log: rows are kept under the run that wrote them."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillsight.schemas import METRIC_SCHEMA
from tillsight.sources.writers import write_run

LOG_SCHEMA = StructType([*METRIC_SCHEMA.fields, StructField("run", StringType())])


def append_metrics(records: DataFrame, path: str, run: str | None = None) -> str:
    """Add the metric rows of a run and return its name; rows of other runs are not read or rewritten.

    A run that is written again, for instance because its job was ended before or after the commit, replaces its own
    rows, so each of its metrics is there once. Without a name every call is a run of its own.
    """
    run = run or uuid.uuid4().hex
    write_run(records.select(*METRIC_SCHEMA.fieldNames()), path, run, file_format="json")
    return run


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All metric rows with their `run`, or none when nothing was written yet."""
    try:
        return spark.read.schema(LOG_SCHEMA).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)
