"""Centroid clustering by Lloyd's rounds, sharded by dimension.

Vectors are cut into blocks of columns. A task holds slices of one block and the centroids' slice of that block, and adds up
exact squared distances over its own columns only. The parts of a vector meet by its chunk, are added, and the nearest centroid
is taken. The assignment goes back to the blocks, and each block renews its own slice of the centroids; no task sees all
columns of a centroid, and no centroid passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from tillsight.llm.common import table
from tillsight.plans.shared import new_path, stored

COMPONENTS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Columns of a block, and vectors of a chunk: a slice is one chunk of one block.
WIDTH = 16
CHUNK_ROWS = 4096
#: Slices per bucket of the slice table at most, once there are as many buckets as cores.
BUCKET_SLICES = 64

SLICES = "chunk bigint, block int, size int, data binary"


@dataclass
class Clustering:
    """`assigned` has the named id column, `cluster` and `distance` of every clustered vector, `centroids` one component per row
    (`block`, `cluster`, `position` in the whole vector, `value`)."""

    assigned: DataFrame
    centroids: DataFrame


def usable(vector: Column, components: int) -> Column:
    """Exactly so many components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def whole_numbers(vector: Column, components: int, scale: int) -> Column:
    """floor(scale * x) of each component; the job fails where squared distances would leave 64 bits."""
    most = isqrt((1 << 61) // (4 * components))
    too_large = F.raise_error(F.lit(f"a component times {scale} is beyond {most}"))
    value = lambda x: x.cast("double") * scale
    return F.transform(vector, lambda x: F.when(F.abs(value(x)) < most, F.floor(value(x))).otherwise(too_large.cast("bigint")))


def first_centroids(rows: DataFrame, clusters: int, seed: int, width: int) -> DataFrame:
    """Components of the vectors whose ids hash lowest, numbered in that order; null ids give none, equal ids go by vector."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = rows.where("id is not null").select(order.alias("order"), "vector").orderBy("order", "vector").limit(clusters)
    # At most `clusters` rows are numbered.
    numbered = chosen.agg(F.array_sort(F.collect_list(F.struct("order", "vector"))).alias("all")).select(F.posexplode("all").alias("cluster", "row"))
    return numbered.select("cluster", F.posexplode("row.vector").alias("position", "value")).select(
        F.floor(F.col("position") / width).cast("int").alias("block"), "cluster", "position", "value"
    )


def cut(rows: DataFrame, components: int, width: int) -> DataFrame:
    """Chunks of rows cut into blocks of columns: one row per chunk and block, the ids beside block 0.

    A slice holds its numbers in the narrowest width that fits them, vector by vector.
    """
    identity = rows.schema["id"].dataType
    schema = StructType([*StructType.fromDDL(SLICES).fields, StructField("ids", ArrayType(identity))])
    kind = pa.list_(to_arrow_type(identity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(start, CHUNK_ROWS)
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
                blocks = range(0, components, width)
                slices = []
                for first in blocks:
                    own = matrix[:, first : first + width]
                    slices.append(own.astype(np.min_scalar_type(-int(abs(own).max()) - 1)))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                beside = pa.concat_arrays([ids.cast(kind), pa.nulls(len(blocks) - 1, kind)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(blocks), pa.int64()),
                        pa.array(range(len(blocks)), pa.int32()),
                        pa.array([s.itemsize for s in slices], pa.int32()),
                        pa.array([s.tobytes() for s in slices], pa.binary()),
                        beside,
                    ],
                    names=["chunk", "block", "size", "data", "ids"],
                )
                number += 1

    return rows.select("id", "vector").mapInArrow(run, schema)


def bucketed(slices: DataFrame, count: int) -> DataFrame:
    """The slices as a table in buckets of block and chunk: a join on both leaves them where they are."""
    spark = slices.sparkSession
    name = f"slices_{uuid.uuid4().hex}"
    dealt = slices.repartition(count, "block", "chunk")
    dealt.write.bucketBy(count, "block", "chunk").sortBy("block", "chunk").option("path", new_path(spark, "slices")).saveAsTable(name)
    return spark.table(name)


def _numbers(data: bytes, size: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{size}").reshape(-1, width).astype(np.int64)


def nearest(slices: DataFrame, centroids: DataFrame, components: int, width: int) -> DataFrame:
    """Cluster and squared distance of every vector of a chunk; ties go to the smaller number.

    Every slice adds up distances over its own columns; the parts of a chunk (one per block) are summed where they meet.
    """
    order = F.array_sort(F.collect_list(F.struct("cluster", "position", "value")))
    own = centroids.groupBy("block").agg(F.transform(order, lambda x: x["value"]).alias("centre"))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, parts = batch.column("chunk"), []
            for block, size, data, centre in zip(*(batch.column(c) for c in ("block", "size", "data", "centre")), strict=True):
                wide = min(width, components - block.as_py() * width)
                c = centre.values.to_numpy().reshape(-1, wide)
                x = _numbers(data.as_py(), size.as_py(), wide)
                part = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
                parts.append(part.astype(np.min_scalar_type(part.max())))
            yield pa.RecordBatch.from_arrays(
                [chunks, pa.array([p.itemsize for p in parts], pa.int32()), pa.array([p.shape[1] for p in parts], pa.int32()),
                 pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["chunk", "size", "clusters", "part"],
            )

    def add(parts: pa.Table) -> pa.Table:
        total = 0
        for size, clusters, part in zip(*(parts.column(c).to_pylist() for c in ("size", "clusters", "part")), strict=True):
            total = total + np.frombuffer(part, f"<u{size}").reshape(-1, clusters).astype(np.int64)
        cluster = total.argmin(axis=1)
        distance = total[np.arange(len(total)), cluster]
        return pa.table(
            {
                "chunk": parts.column("chunk").slice(0, 1),
                "cluster": pa.array([cluster.astype(np.int32)], pa.list_(pa.int32())),
                "distance": pa.array([distance], pa.list_(pa.int64())),
            }
        )

    beside = slices.select("chunk", "block", "size", "data").join(own, "block")
    parts = beside.mapInArrow(distances, "chunk bigint, size int, clusters int, part binary")
    return parts.groupBy("chunk").applyInArrow(add, "chunk bigint, cluster array<int>, distance array<bigint>")


def renewed(slices: DataFrame, assigned: DataFrame, centroids: DataFrame, components: int, width: int) -> DataFrame:
    """Each component of a centroid with vectors becomes floor(sum / count) over them; others stay.

    Assignments are sent to every block; slices stay in their buckets and are summed there before anything moves.
    """
    blocks = ceil(components / width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block, size, data, cluster in zip(*(batch.column(c) for c in ("block", "size", "data", "cluster")), strict=True):
                block = block.as_py()
                wide = min(width, components - block * width)
                x, own = _numbers(data.as_py(), size.as_py(), wide), cluster.values.to_numpy()
                for k, n in zip(*np.unique(own, return_counts=True), strict=True):
                    total = held.setdefault((block, int(k)), [np.zeros(wide, np.int64), 0])
                    total[0] += x[own == k].sum(axis=0)
                    total[1] += int(n)
        rows = [(b, k, b * width + i, int(v), n) for (b, k), (total, n) in held.items() for i, v in enumerate(total)]
        names = ["block", "cluster", "position", "total", "vectors"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    sent = assigned.select("chunk", "cluster", F.explode(F.array(*map(F.lit, range(blocks)))).alias("block"))
    beside = slices.select("chunk", "block", "size", "data").join(sent, ["block", "chunk"])
    parts = beside.mapInArrow(sums, "block int, cluster int, position int, total bigint, vectors bigint")
    totals = parts.groupBy("block", "cluster", "position").agg(F.sum("total").alias("total"), F.sum("vectors").alias("vectors"))
    mean = F.expr("(total - pmod(total, vectors)) div vectors")
    return centroids.join(totals, ["block", "cluster", "position"], "left").select(
        "block", "cluster", "position", F.coalesce(mean, F.col("value")).alias("value")
    )


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: int = SEED,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    width: int = WIDTH,
) -> Clustering:
    """Cluster the vectors that have exactly `components` components, none null or non-finite; all other rows are left out.

    Components count as floor(scale * x), and everything after that is exact. The first centroids are the vectors whose ids have
    the smallest sha256 of `seed:id`; equal ids are ordered by their vectors, null ids are clustered but never a first
    centroid (without any other vector the job fails). With fewer such vectors than `clusters` there are as many centroids as vectors; without any the result is empty.
    Repeated rows are vectors of their own, and ties go to the smaller cluster number. A centroid without vectors stays where it
    is. Only the two named columns are read. Components so large that a squared distance would not fit 64 bits fail the job.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    rows = named.where(usable(F.col("vector"), components)).withColumn("vector", whole_numbers(F.col("vector"), components, scale))
    centroids = stored(first_centroids(rows, clusters, seed, width), "centroids")
    if centroids.isEmpty() and not rows.isEmpty():
        raise ValueError("no vector has an id, so there is no first centroid")
    pieces = ceil(rows.count() / CHUNK_ROWS) * ceil(components / width)
    buckets = max(1, min(pieces, 2 * spark.sparkContext.defaultParallelism), pieces // BUCKET_SLICES)
    slices = bucketed(cut(rows, components, width), buckets)
    for _ in range(rounds):
        assigned = nearest(slices, centroids, components, width)
        centroids = stored(renewed(slices, assigned, centroids, components, width), "centroids")
    last = stored(nearest(slices, centroids, components, width), "assigned-chunks")
    ids = slices.where("block = 0").select("chunk", "ids")
    each = ids.join(last, "chunk").select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("v"))
    return Clustering(each.select(F.col("v.ids").alias(vec_id), "v.cluster", "v.distance"), centroids)


def with_figures(found: Clustering) -> DataFrame:
    """The assigned vectors with `cluster_inertia`, `inertia` and `centroid_sha256`; one small row per cluster is joined."""
    sums = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    order = F.array_sort(F.collect_list(F.struct("position", "value")))
    digests = found.centroids.groupBy("cluster").agg(
        F.sha2(F.array_join(F.transform(order, lambda x: x["value"].cast("string")), ","), 256).alias("centroid_sha256")
    )
    figures = stored(sums.join(digests, "cluster"), "cluster-figures")
    total = figures.agg(F.sum("cluster_inertia").alias("inertia"))
    return found.assigned.join(figures.withColumn("inertia", total.scalar()), "cluster")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and digests of every usable vector."""
    found = with_figures(cluster_vectors(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    """Assignments a0 to a3 and centroids c0 to c3, one pair of steps per round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} as materialized (
    select r, vec_id, q, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance
    from (select r, vec_id, q, cluster, list_sum(list_transform(range(1, {COMPONENTS + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) as d
          from kept, c{r})
    group by r, vec_id, q
)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} as materialized (
    select o.cluster, coalesce(n.c, o.c) as c from c{r} o left join (
        select cluster, list(m order by i) as c from (
            select cluster, i, (sum(q[i]) - ((sum(q[i]) % count(*)) + count(*)) % count(*)) // count(*) as m
            from a{r}, range(1, {COMPONENTS + 1}) t(i) group by cluster, i
        ) group by cluster
    ) n using (cluster)
)""")
    return ",\n".join(steps)


OP13_SQL = f"""
with kept as materialized (
    select row_number() over () as r, vec_id, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as q from embeddings
    where len(embedding) = {COMPONENTS} and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), c0 as materialized (
    select row_number() over (order by h, q) - 1 as cluster, q as c
    from (select sha256('{SEED}:' || vec_id) as h, q from kept where vec_id is not null order by h, q limit {CLUSTERS})
), {_rounds_sql()}
select vec_id, cast(cluster as integer) as cluster, cast(distance as bigint) as distance,
    cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
    sha256(array_to_string(c, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} using (cluster)
"""
