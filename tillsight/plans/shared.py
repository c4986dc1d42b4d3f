"""Intermediate tables in the shared folder.

A small aggregate that is read more than once (a per-customer table, per-group statistics) is
written once and read back. The large input behind it is then scanned a single time, the result
survives the loss of executors, and Spark plans joins against it from the measured file size:
broadcast below `spark.sql.autoBroadcastJoinThreshold`, a shuffle join with skew splitting above.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; on a single machine without one, the warehouse folder of the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/tillsight/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> int:
    count = 0
    for path in paths:
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        count += bool(files.delete(location, True))
    return count


def release(spark: SparkSession) -> int:
    """Delete the tables this process wrote; results built on them can no longer be read."""
    paths = list(_written)
    _written.clear()
    return _delete(spark, paths)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return the table that reads it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Store what `make` returns and delete the tables that were written on the way to it."""
    before = len(_written)
    result = stored(make(), name)
    path = _written.pop()
    passed = _written[before:]
    _written[before:] = [path]
    _delete(spark, passed)
    return result
