"""Shards of nearly equal bytes by a histogram sort.

Rows are put in the order of a hash of id and text. The bytes below candidate keys are counted exactly over all
partitions, and the candidates between which a shard's border must lie are refined round by round until the borders
meet the tolerance. Only then do the rows move, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillsight.llm.common import table, without
from tillsight.plans.shared import stored

SHARDS = 40
ROW_BYTES = 16
#: Hex digits a round adds to the candidate keys: 4096 candidates in each gap that is still open.
DIGITS = 3
KEY_DIGITS = 32
#: Digits of the number that tells rows with equal keys apart.
COPY_DIGITS = 16
#: Rows counted together for the places within a shard.
RUN_ROWS = 4096
#: Sorts after every key that starts with the digits before it.
AFTER = "g"

RESULTS = ["size", "text_crc32", "shard", "slot"]


def row_key(doc_id: Column, text: Column) -> Column:
    """Place of a row in the order: rows equal in id and text share it, no others do but by a collision of md5."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES


def find_splitters(sized: DataFrame, shards: int, tolerance: int = 0) -> list[str]:
    """First keys of shards 1 to shards-1 of a table of `key` and `size`.

    Border k is the smallest key with at least k/shards of all bytes below it; a candidate as close as `tolerance`
    bytes to that share is taken too. A round reads the table once and brings back a bounded number of counts:
    4096 for each gap that holds a border.
    """
    total = sized.agg(F.sum("size")).first()[0]
    if not total:
        return []
    wanted = {k: k * total for k in range(1, shards)}  # times `shards`, to stay exact
    found: dict[int, str] = {}
    gaps: dict[str, int] = {"": 0}  # digits that a gap's keys share -> bytes below the gap
    digits = 0
    while len(found) < len(wanted):
        rows = sized.where(F.substring("key", 1, digits).isin(list(gaps))) if digits else sized
        known, digits = digits, min(digits + DIGITS, KEY_DIGITS + COPY_DIGITS)
        counted = rows.groupBy(F.substring("key", 1, digits).alias("digits")).agg(
            F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        bins = sorted(counted.collect())
        after: dict[str, int] = {}
        below, gap = 0, None
        for row in bins:
            parent = row["digits"][:known]
            if parent != gap:
                gap, below = parent, gaps[parent]
            end = below + row["bytes"]
            for k in [k for k in wanted if k not in found and below * shards < wanted[k] <= end * shards]:
                if end * shards - wanted[k] <= tolerance * shards or row["low"] == row["high"]:
                    found[k] = row["high"] + AFTER if row["low"] == row["high"] else row["digits"] + AFTER
                elif wanted[k] - below * shards <= tolerance * shards:
                    found[k] = row["digits"]
                else:
                    after[row["digits"]] = below
            below = end
        gaps = after
    return [found[k] for k in sorted(found)]


def told_apart(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with keys that no two share, and the keys that did with their numbers of rows (None without any).

    Rows with a key of their own stay as they are. The others are written once with a number each, whose digits follow the
    key, the fast ones first; the number has to be stored, as a second run over the rows could give another.
    """
    repeated = stored(keyed.groupBy("__llm_key").agg(F.count("*").alias("copies")).where("copies > 1"), "repeated-keys")
    if repeated.isEmpty():
        return keyed, None
    number = F.reverse(F.lpad(F.hex(F.monotonically_increasing_id()), COPY_DIGITS, "0"))
    numbered = keyed.join(repeated.select("__llm_key"), "__llm_key", "left_semi").withColumn("__llm_key", F.concat("__llm_key", number))
    alone = keyed.join(repeated.select("__llm_key"), "__llm_key", "left_anti")
    return alone.unionByName(stored(numbered.select(keyed.columns), "numbered-copies")), repeated


def into_shards(documents: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", tolerance: int = 0) -> DataFrame:
    """Every row with `size`, `text_crc32`, `shard` (0 to shards-1) and `slot` (its place there, from 0).

    A shard's share of all bytes is met to within one row, or `tolerance` bytes, also where rows are repeated. Size: bytes of the
    text plus 16, a null text has none (and checksum 0). Null ids are sorted by text. Rows equal in id and text are
    neighbours in the order; a border can lie between them. Equal texts of different ids are spread like any others, so copies
    do not load one shard. An empty table stays empty. Columns named like a result are replaced, others stay.
    """
    base = without(documents, RESULTS)
    value = F.col(f"`{text}`")
    keyed = base.withColumns(
        {
            "__llm_key": row_key(F.col(f"`{doc_id}`"), value),
            "size": row_size(value),
            "text_crc32": F.coalesce(F.crc32(value.cast("binary")), F.lit(0)).cast("bigint"),
        }
    )
    keyed, repeated = told_apart(keyed)
    sized = stored(keyed.select(F.col("__llm_key").alias("key"), "size"), "sized-keys")
    splitters = find_splitters(sized, shards, tolerance)

    def shard_of(key: Column) -> Column:
        # Borders passed, found by halves: about six comparisons for forty shards.
        def between(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(key < splitters[middle], between(low, middle)).otherwise(between(middle + 1, high))

        return between(0, len(splitters)).cast("int")

    digits = _run_digits(sized.count())
    run = ["shard", "__llm_run"]

    def placed(rows: DataFrame, key: str) -> DataFrame:
        return with_runs(rows.withColumn("shard", shard_of(F.col(key))), key, digits, repeated)

    counted = placed(sized, "key").groupBy(run).count()
    # Rows of the shard before each run; a shard has about one run for every 4096 of its rows.
    before = Window.partitionBy("shard").orderBy("__llm_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(counted.select(*run, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__llm_before")), "shard-runs")
    number = F.row_number().over(Window.partitionBy(run).orderBy("__llm_key"))
    slotted = placed(keyed, "__llm_key").withColumn("__llm_number", number).join(runs, run)
    return slotted.withColumn("slot", F.col("__llm_before") + F.col("__llm_number") - 1).drop("__llm_key", "__llm_run", "__llm_number", "__llm_before")


def _run_digits(rows: int) -> int:
    digits = 1
    while rows >> (4 * digits) > RUN_ROWS:
        digits += 1
    return digits


def with_runs(rows: DataFrame, key: str, digits: int, repeated: DataFrame | None) -> DataFrame:
    """Add `__llm_run`: rows that are numbered together, in the order of their keys; about RUN_ROWS of them share one.

    A run is the first digits of the key. A key with more than RUN_ROWS copies is cut out of it, in runs of its own by the
    first digits of the copies' numbers, between the rows below and those above it.
    """
    start = F.substring(key, 1, digits)
    most = repeated.agg(F.max("copies")).first()[0] if repeated is not None else 0
    if most <= RUN_ROWS:
        return rows.withColumn("__llm_run", start)
    # At most one in RUN_ROWS of the rows' number; those of one run come in a short array.
    hot = repeated.where(F.col("copies") > RUN_ROWS).groupBy(F.substring("__llm_key", 1, digits).alias("__llm_start"))
    hot = stored(hot.agg(F.collect_list("__llm_key").alias("__llm_hot")), "hot-keys")
    beside = rows.withColumn("__llm_start", start).join(hot, "__llm_start", "left")
    below = F.coalesce(F.size(F.filter("__llm_hot", lambda h: h < F.col(key))), F.lit(0))
    own = F.array_contains("__llm_hot", F.substring(key, 1, KEY_DIGITS)) & (F.length(key) > KEY_DIGITS)
    part = F.when(own, F.substring(key, KEY_DIGITS + 1, _run_digits(most))).otherwise(AFTER)
    return beside.withColumn("__llm_run", F.concat_ws(":", "__llm_start", F.lpad(below.cast("string"), 6, "0"), part)).drop("__llm_start", "__llm_hot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    found = into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _crc_of_nibble(nibble: int) -> int:
    for _ in range(4):
        nibble = nibble >> 1 ^ (0xEDB88320 if nibble & 1 else 0)
    return nibble


#: CRC-32 of a text's UTF-8 bytes, half a byte at a time, the lower half first.
CRC_SQL = f"""xor(list_reduce(list_prepend(4294967295::ubigint,
        [cast(strpos('123456789ABCDEF', h[if(i % 2 = 0, i + 2, i)]) as ubigint) for i in range(0, len(h))]),
        lambda c, n: xor(({[_crc_of_nibble(n) for n in range(16)]}::ubigint[])[cast(xor(c, n) & 15 as bigint) + 1], c >> 4)), 4294967295)"""

OP10_SQL = f"""
with sized as (
    select doc_id, string_split(hex(encode(coalesce(text, ''))), '') as h, md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as key,
        coalesce(strlen(text), 0) + 16 as size
    from documents
), placed as (
    select *, coalesce(sum(size) over (order by key rows between unbounded preceding and 1 preceding), 0) * 40 // sum(size) over () as shard
    from sized
)
select doc_id, cast(size as bigint) as size, cast({CRC_SQL} as bigint) as text_crc32, 'bytes' as law, cast(shard as integer) as shard,
    row_number() over (partition by shard order by key) - 1 as slot, cast(null as integer) as grown_shard
from placed
"""
