"""Table readers: raw CSV, record feeds and text documents."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from tillsight.plans.shared import stored
from tillsight.schemas import FEEDS, dataset

CORRUPT = "corrupt_record"
CORRUPT_FILE = "corrupt_file"
#: Bytes read at a time while looking for a header.
HEADER_BYTES = 1 << 16


def read_raw(
    spark: SparkSession, name: str, path: str, *, multi_line: bool = True, one_header: bool = False
) -> DataFrame:
    """CSV files of a dataset as text columns, matched by the header of each file; absent columns are null.

    Line breaks inside quoted fields belong to the field; `multi_line=False` takes every line as a record, which
    lets Spark split large files. Headers are taken from the first bytes of the files, in tasks. Files that agree are
    read by name; files with different headers are read once, by position, beside a table of their places. A name that
    comes twice counts where it comes first. `one_header=True` promises that all files name the same columns in the
    same order and saves looking.
    """
    wanted = [column for column, _ in dataset(name).all_columns]
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("multiLine", multi_line)
    )
    if one_header:
        return _columns(reader.csv(path), wanted)
    headers = stored(file_headers(spark, path), "csv-headers")
    kinds = headers.groupBy("names").agg(F.max(F.size("names")).alias("width")).limit(2).collect()
    if not kinds:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in wanted))
    if len(kinds) == 1:
        found = kinds[0]["names"]
        # A name that is not read, or comes twice, gets one that is not used.
        names = [c if c in wanted and found.index(c) == i else f"_{i}" for i, c in enumerate(found)]
        return _columns(reader.schema(_texts(names)).csv(path), wanted)
    width = headers.agg(F.max(F.size("names"))).first()[0]
    places = headers.select("file", *(F.array_position("names", c).alias(f"_at{i}") for i, c in enumerate(wanted)))
    by_place = reader.schema(_texts([f"_{i}" for i in range(width)])).csv(path)
    values = F.array(*(F.col(f"_{i}") for i in range(width)))
    beside = by_place.select(values.alias("_values"), F.col("_metadata.file_path").alias("file")).join(places, "file")
    # Place 0 means the file does not have the column; `get` gives null there.
    return beside.select(*(F.get("_values", F.col(f"_at{i}").cast("int") - 1).alias(c) for i, c in enumerate(wanted)))


def _texts(names: list[str]) -> StructType:
    schema = StructType()
    for column in names:
        schema.add(column, StringType())
    return schema


def _columns(raw: DataFrame, wanted: list[str]) -> DataFrame:
    known = set(raw.columns)
    return raw.select(
        *[F.col(f"`{c}`") if c in known else F.lit(None).cast("string").alias(c) for c in wanted]
    )


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """`file`, `names`: the first record of every CSV file that has one, read in tasks.

    Only the first bytes of a file are read, plain or compressed, through Arrow's file systems (local, HDFS, S3, GCS). A store
    that only Spark can open is scanned for its first lines instead.
    """
    if not _arrow_reaches(path):
        return _scanned_headers(spark, path)

    def first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(file, first_record(file)) for file in batch.column(0).to_pylist()]
            found = [(file, names) for file, names in found if names]
            columns = [pa.array([f for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "names"])

    # The content column is not selected, so listing reads no file.
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    return files.mapInArrow(first_records, "file string, names array<string>")


def first_record(file: str) -> list[str] | None:
    """Fields of the first record that is not blank; None for a file without one."""
    system, location = pafs.FileSystem.from_uri(file)
    kinds = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4"}
    packed = next((kind for ending, kind in kinds.items() if location.endswith(ending)), None)
    with system.open_input_stream(location, compression=packed, buffer_size=HEADER_BYTES) as stream:
        lines = io.TextIOWrapper(stream, "utf-8-sig", newline="")
        return next((record for record in csv.reader(lines) if record), None)


def _arrow_reaches(path: str) -> bool:
    try:
        pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{os.path.abspath(path)}")
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return False
    return True


def _scanned_headers(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.filter("start = 0 and value <> ''").groupBy("file").agg(F.min_by("value", "line").alias("header"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [next(csv.reader([header.removeprefix("\ufeff")])) for header in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string()))], names=["file", "names"])

    return first.mapInArrow(split, "file string, names array<string>")


def read_feed(
    spark: SparkSession, name: str, path: str, file_format: str = "json", *, broken: str = "fail"
) -> DataFrame:
    """Record feed (JSON lines or parquet) with its declared schema; nothing is inferred.

    A line that is no JSON record, or has a value of the wrong kind, fails the job; `broken="keep"` keeps it
    instead, whole, in the added column `corrupt_record` (null for good records).
    """
    if file_format != "json":
        return spark.read.schema(FEEDS[name]).format(file_format).load(path)
    if broken == "fail":
        return spark.read.schema(FEEDS[name]).option("mode", "FAILFAST").json(path)
    if broken != "keep":
        raise ValueError(f"broken is 'fail' or 'keep', not {broken!r}")
    reader = spark.read.schema(f"{FEEDS[name]}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(path)


def read_notices(spark: SparkSession, path: str, *, broken: str = "fail") -> DataFrame:
    """One row per text file: `notice_text`, its name as `source_name`, its time as `uploaded_at`.

    Texts are decoded strictly: a file that is no UTF-8 fails the job; `broken="keep"` keeps it instead with a null text
    and its bytes in the added column `corrupt_file` (null for good files). Columns that folders name (`name=value`) are kept.
    Spark lists no files of zero bytes, so they have no row.
    """
    if broken not in ("fail", "keep"):
        raise ValueError(f"broken is 'fail' or 'keep', not {broken!r}")
    raw = F.col("content").cast("string")
    good = F.is_valid_utf8(raw)
    failed = F.raise_error(F.concat(F.lit("no UTF-8 text: "), F.col("_metadata.file_path"))).cast("string")
    text = F.when(good, raw).otherwise(failed if broken == "fail" else F.lit(None))
    columns = [
        text.alias("notice_text"),
        F.col("_metadata.file_name").alias("source_name"),
        F.col("_metadata.file_modification_time").alias("uploaded_at"),
        F.lit(True).alias("from_file"),
    ]
    if broken == "keep":
        columns.append(F.when(~good, F.col("content")).alias(CORRUPT_FILE))
    files = spark.read.format("binaryFile").load(path)
    folders = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select(*columns, *(F.col(f"`{c}`") for c in folders))
