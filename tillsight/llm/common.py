"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to a Python function at once; an Arrow batch is cut into pieces of about this many bytes.
PIECE_BYTES = 4 << 20
#: A stored table of narrow rows is sent to every task up to this many rows; beyond that both sides are shuffled.
SENT_ROWS = 500_000
#: Values in an array column of a table that is sent, over all its rows.
SENT_VALUES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` less the columns that would clash with result columns (names compare without case)."""
    taken = {name.lower() for name in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def sent_if_small(stored: DataFrame, array: str | None = None) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast when its counted rows, and the values in its column `array`, are few enough."""
    if array and (stored.agg(F.sum(F.size(array).cast("bigint"))).first()[0] or 0) > SENT_VALUES:
        return stored
    return F.broadcast(stored) if stored.limit(SENT_ROWS + 1).count() <= SENT_ROWS else stored


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; null where the value is null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def crc_fold(value: object, modulus: int) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode()) % modulus


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut a batch into pieces of bounded text, each with its texts as UTF-8 bytes; a single text is never cut."""
    raw = batch.column(text).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > PIECE_BYTES:
            yield batch.slice(start, i - start), raw.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start), raw.slice(start).to_pylist()


def map_texts(
    df: DataFrame,
    text: str,
    results: str,
    make: Callable[[], Callable[[list[bytes | None]], list[list]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from whole texts in Arrow batches, keeping every row as it is.

    `results` is a DDL list of the new columns; `make` runs once per task and returns a function from the
    texts of a piece (UTF-8 bytes, null as None) to one list per new column. Input columns with the name of
    a new one are replaced; `keep` names the input columns to return (all by default).
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(results)
    base = without(df, [f.name for f in added.fields if f.name.lower() != text.lower()])
    kept = [c for c in base.columns if keep is None or c in keep]
    source = base.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__llm_text"))
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in added.fields]
    replaced = {name.lower() for name in names}
    stay = [i for i, c in enumerate(kept) if c.lower() not in replaced]
    schema = StructType([source.schema.fields[i] for i in stay] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part, texts in pieces(batch, batch.num_columns - 1):
                values = compute(texts)
                arrays = [part.column(i) for i in stay]
                arrays += [pa.array(v, type=kind) for v, kind in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[kept[i] for i in stay] + names)

    return source.mapInArrow(run, schema)
