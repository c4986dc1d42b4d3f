"""Spark session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where the next aggregation could have reused its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def pin(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session made elsewhere; all of them are runtime settings."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


# One shuffle partition per this much input.
INPUT_PER_PARTITION = 192 << 20


def size_shuffles(spark: SparkSession, *paths: str) -> int:
    """Raise `spark.sql.shuffle.partitions` to suit the bytes under the tables read; never lowers it.

    Adaptive execution merges partitions that turn out small but cannot add any, so a job over a
    very large input has to start with enough of them.
    """
    size = 0
    for path in paths:
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        size += files.getContentSummary(location).getLength()
    needed = size // INPUT_PER_PARTITION + 1
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), needed)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return partitions


def local_session(
    cores: str = "*", app: str = "tillsight", memory: str = "8g", partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A single-machine session for tests and benchmarks; `shared` is the folder for intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return pin(builder.getOrCreate())
