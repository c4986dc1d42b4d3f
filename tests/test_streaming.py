"""Streams of receipts against the batch operator, with late rows and batches that run again."""

from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillsight.operators.risk import cancel_anomalies, cancel_slots, slot_anomalies
from tillsight.sources.writers import write_run
from tillsight.streaming.slots import closed_slots, stream_slots, streamed_slots

KIND = "receipt_no string, store_id string, event_time timestamp, status string"
START = datetime(2026, 3, 1)


def receipts(spark, hours):
    data = [(f"r{i}", f"s{i % 2}", START + timedelta(hours=h), "cancelled" if i % 3 == 0 else "completed") for i, h in enumerate(hours)]
    return spark.createDataFrame(data, KIND)


def as_batch(table):
    return table.withColumns({"sales_date": F.to_date("event_time"), "sales_time": F.date_format("event_time", "HH:mm")})


def file_stream(spark, folder, parts):
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.mark.parametrize("keys", [(), ("store_id",)])
def test_streamed_slots_equal_the_batch(spark, tmp_path, keys):
    parts = [receipts(spark, hours) for hours in ([0.1, 0.5, 1.2], [30.0, 31.5, 31.6], [0.2, 2.2], [])]
    stream = as_batch(file_stream(spark, tmp_path / "in", parts))
    for _ in range(2):  # a second start finds nothing new
        stream_slots(stream, str(tmp_path / "slots"), str(tmp_path / "state"), keys).awaitTermination()
    whole = as_batch(parts[0].union(parts[1]).union(parts[2]))
    schema = cancel_slots(whole, keys).schema
    found = streamed_slots(spark, str(tmp_path / "slots"), schema, keys)
    assert rows(slot_anomalies(found, keys), *keys, "sales_date", "hour") == rows(cancel_anomalies(whole, keys), *keys, "sales_date", "hour")


def test_a_replayed_batch_counts_once(spark, tmp_path):
    slots = cancel_slots(as_batch(receipts(spark, [0.1, 0.5, 1.2])))
    for run in ("000000000000", "000000000001", "000000000001"):
        write_run(slots, str(tmp_path / "slots"), run)
    found = streamed_slots(spark, str(tmp_path / "slots"), slots.schema)
    assert {r["hour"]: r["total_count"] for r in found.collect()} == {0: 4, 1: 2}


def test_closed_slots_come_once_and_late_rows_are_defined(spark, tmp_path):
    """Late in an open hour counts, late in a closed one does not; the last hours stay open."""
    parts = [receipts(spark, hours) for hours in ([0.1, 0.5, 1.2], [2.9, 0.7], [9.0], [8.5], [0.2], [30.0], [31.0])]
    stream = closed_slots(file_stream(spark, tmp_path / "in", parts), delay="2 hours")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start(str(tmp_path / "closed")).awaitTermination()
    found = [(str(r["sales_date"]), r["hour"], r["total_count"]) for r in spark.read.parquet(str(tmp_path / "closed")).collect()]
    # 0.7 came before its hour was closed, 0.2 when it had been given out: the watermark was at 7 a batch before.
    assert sorted(found) == [("2026-03-01", 0, 3), ("2026-03-01", 1, 1), ("2026-03-01", 2, 1), ("2026-03-01", 8, 1), ("2026-03-01", 9, 1)]
