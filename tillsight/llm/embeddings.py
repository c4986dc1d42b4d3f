"""Near-duplicate embeddings by an exact tiled comparison in the order of principal components.

Unit vectors are turned so that their leading dimensions hold most of their length. Tiles of one label are compared in
pairs: products are added up over the leading dimensions first, and what the others can still add is bounded by
the norms of the suffixes. Pairs that cannot reach the threshold are left, and a tile pair stops when none is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm.common import sent_if_small, table
from tillsight.llm.graph import Forest, connected_components
from tillsight.plans.shared import stored

COSINE = 0.93
#: Rows of a tile: eight times the root of the label's rows, within these bounds.
LEAST_TILE, MOST_TILE = 512, 16_384
#: Rows of a tile multiplied at once, and the dimensions of each step.
BLOCK = 1024
STEPS = (8, 16, 32, 64, 128, 256, 512, 1024)
#: Share of open pairs below which the rest is computed pair by pair.
FEW = 0.05
#: Widens bounds by what rounding can change.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def principal_axes(vectors: DataFrame, dimensions: list[int]) -> dict[int, np.ndarray]:
    """Axes of the unit vectors of each dimension, from the sums of their products over all rows."""
    axes = {}
    for dimension in dimensions:

        def run(batches: Iterator[pa.RecordBatch], dimension=dimension) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dimension, dimension))
            for batch in batches:
                if batch.num_rows:
                    unit = _unit(_matrix(batch.column(0), dimension))
                    total += unit.T @ unit
            yield pa.RecordBatch.from_arrays([pa.array(range(dimension**2), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

        own = vectors.where(F.size("vector") == dimension).select("vector")
        sums = own.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        matrix = np.zeros(dimension**2)
        for row in sums:
            matrix[row["cell"]] = row["value"]
        axes[dimension] = np.linalg.eigh(matrix.reshape(dimension, dimension))[1][:, ::-1].copy()
    return axes


def near_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of unit vectors whose cosine is at least `least`, block by block."""
    xr, yr = x @ axes, y @ axes
    bounds = [0, *[s for s in STEPS if s < x.shape[1]], x.shape[1]]
    rest_x, rest_y = ([np.sqrt(np.einsum("ij,ij->i", r[:, b:], r[:, b:])) for b in bounds] for r in (xr, yr))
    for i in range(0, len(x), BLOCK):
        for j in range(0, len(y), BLOCK):
            here, there = slice(i, i + BLOCK), slice(j, j + BLOCK)
            products = np.zeros((len(x[here]), len(y[there])))
            for k in range(1, len(bounds)):
                part = slice(bounds[k - 1], bounds[k])
                products += xr[here, part] @ yr[there, part].T
                open_ = products + np.outer(rest_x[k][here], rest_y[k][there]) >= least - SLACK
                count = np.count_nonzero(open_)
                if count <= FEW * open_.size or k == len(bounds) - 1:
                    break
            if count:
                a, b = np.nonzero(open_)
                a, b = a + i, b + j
                for c in range(0, len(a), BLOCK * 64):
                    p, q = a[c : c + BLOCK * 64], b[c : c + BLOCK * 64]
                    near = np.einsum("ij,ij->i", x[p], y[q]) >= least
                    yield p[near], q[near]


RESULT = "a bigint, b bigint, links bigint"


def tile_links(tiles: DataFrame, axes: dict[int, np.ndarray], least: float) -> DataFrame:
    """Links of each tile pair: for a vector the number of vectors it links to (b null), and tree links (links 0)."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        dimension = len(batch.column("vector")[0])
        vectors = _unit(_matrix(batch.column("vector").combine_chunks(), dimension))
        side, rep, copies = (batch.column(c).to_numpy() for c in ("side", "rep", "copies"))
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a tile with itself
        own = bool((side == 2).any())
        forest, links = Forest(len(rep)), np.zeros(len(rep), np.int64)
        for p, q in near_pairs(vectors[first], vectors[second], axes[dimension], least):
            p, q = first[p], second[q]
            other = p != q
            p, q = p[other], q[other]
            np.add.at(links, p, copies[q])
            if not own:
                np.add.at(links, q, copies[p])
            forest.join(p, q)
        root = forest.roots()
        linked, child = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        none = np.zeros(len(child), np.int64)
        return pa.table(
            {
                "a": pa.array(np.concatenate([rep[linked], rep[child]])),
                "b": pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(rep[root[child]])]),
                "links": pa.array(np.concatenate([links[linked], none])),
            }
        )

    return tiles.groupBy("pair").applyInArrow(run, RESULT)


def near_duplicates(
    embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = COSINE
) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` of every row.

    Rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is
    at least `least`. Vectors that are null, empty, zero or hold null or non-finite components, and vectors of
    different lengths, do not link; such a row is its own component. The component is the smallest id reachable;
    null ids name none. Repeated rows are vectors of their own. Equal vectors of a label are compared once and
    counted as often as they occur. Only the named columns are read; an empty table gives an empty result.
    """
    rows = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    good = F.coalesce(usable(F.col("vector")) & F.col("label").isNotNull(), F.lit(False))
    # The same number for equal vectors of a label; null where nothing can link.
    rows = rows.withColumn("rep", F.when(good, F.xxhash64("label", "vector")))
    places = stored(rows.select("vec_id", "rep"), "vector-rows")
    reps = rows.where("rep is not null").groupBy("rep", "label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    reps = stored(reps, "distinct-vectors")
    axes = principal_axes(reps, [r[0] for r in reps.select(F.size("vector")).distinct().collect()])

    groups = reps.groupBy("label", F.size("vector").alias("dimension")).count()
    wanted = F.least(F.greatest(F.sqrt("count") * 8, F.lit(LEAST_TILE)), F.lit(MOST_TILE))
    groups = stored(groups.select("label", "dimension", F.ceil(F.col("count") / wanted).cast("int").alias("tiles")), "label-tiles")
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("tile", k).alias("i"), F.greatest("tile", k).alias("j")))
    side = F.when(F.col("p.i") == F.col("p.j"), 2).when(F.col("p.i") == F.col("tile"), 0).otherwise(1)
    tiles = (
        reps.withColumn("dimension", F.size("vector")).join(sent_if_small(groups), ["label", "dimension"])
        .withColumn("tile", tile).withColumn("p", F.explode(others))
        .select(F.xxhash64("label", "dimension", "p.i", "p.j").alias("pair"), side.alias("side"), "rep", "copies", "vector")
    )
    found = stored(tile_links(tiles, axes, least), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    nodes = stored(connected_components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "rep"), "vector-components")
    ids = reps.select("rep", "copies", "least_id")
    joined = nodes.join(ids, "rep").groupBy("component").agg(F.min("least_id").alias("joined_id"))
    result = (
        ids.join(nodes.join(joined, "component").select("rep", "joined_id"), "rep", "left").join(counts, "rep", "left")
        .select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("joined_id", "least_id").alias("joined_id"))
    )
    alone = F.col("rep").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("joined_id")).alias("component_id")
    all_rows = places.join(result, "rep", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component)
    return all_rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with recursive vectors as (
    select row_number() over () as r, vec_id, label, cast(embedding as double[]) as v from embeddings
), good as (
    select r, vec_id, label, v from vectors
    where v is not null and label is not null and len([x for x in v if x is null or not isfinite(x)]) = 0
        and len([x for x in v if x <> 0]) > 0
), links as (
    select a.r as a, b.r as b from good a join good b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.93
), reach as (
    select r as a, r as b from vectors
    union
    select x.a, l.b from reach x join links l on x.b = l.a
), components as (
    select a, min(v.vec_id) as component_id from reach join vectors v on v.r = b group by a
), counts as (
    select a, count(*) as n from links group by a
)
select v.vec_id, coalesce(n, 0) as n_links, component_id, v.vec_id is not distinct from component_id as kept
from vectors v join components c on c.a = v.r left join counts on counts.a = v.r
"""
