"""Receipts as a stream, folded to hourly slots.

Two ways, for two uses. `stream_slots` writes what every micro-batch adds to its slots; the sum over all batches is the batch result,
and a receipt that comes late is counted when it comes. `closed_slots` keeps the open hours as state and emits every hour
once, when the watermark has passed it; what comes later than that is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tillsight.operators.risk import cancel_slots
from tillsight.sources.writers import write_run

COUNTS = ("total_count", "cancel_count")


def stream_slots(receipts: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ()) -> StreamingQuery:
    """Start the fold of a stream of receipts into slot counts under `path`; stops when all that is there has been read.

    A micro-batch is kept under its number, and one that runs again after a failure replaces its own rows, so each receipt
    counts once.
    """

    def fold(batch: DataFrame, number: int) -> None:
        write_run(cancel_slots(batch, keys), path, f"{number:012d}")

    started = receipts.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return started.trigger(availableNow=True).start()


def streamed_slots(spark: SparkSession, path: str, slots: StructType, keys: Sequence[str] = ()) -> DataFrame:
    """The slots counted so far, one row each; `slots` is the schema of `cancel_slots`."""
    parts = spark.read.schema(StructType([*slots.fields, StructField("run", StringType())])).parquet(path)
    return parts.groupBy(*keys, "sales_date", "hour").agg(*(F.sum(name).alias(name) for name in COUNTS))


def closed_slots(receipts: DataFrame, keys: Sequence[str] = (), *, time: str = "event_time", delay: str = "2 hours") -> DataFrame:
    """A stream of finished slots: each (sales_date, hour) once, after the watermark has passed its end.

    The watermark stays `delay` behind the latest event time seen. A receipt of an hour that has been given out is
    left out (Spark counts such rows in the query's progress); one that is late but whose hour has not counts. Only open
    hours are held as state. Write the stream in append mode.
    """
    hours = receipts.withWatermark(time, delay).groupBy(*keys, F.window(time, "1 hour").alias("_window")).agg(
        F.count("receipt_no").alias("total_count"), F.count_if(F.col("status") == "cancelled").alias("cancel_count")
    )
    start = F.col("_window.start")
    return hours.select(*keys, F.to_date(start).alias("sales_date"), F.hour(start).alias("hour"), *COUNTS)
