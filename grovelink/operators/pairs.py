"""Graphs from points: all pairs, threshold, nearest neighbours, complete forest.

Pairs are enumerated by *block pairs*. Ids are hashed to B blocks and every
vertex is sent to the B unordered block pairs it belongs to, so a task sees at
most two blocks of bounded size whatever the distribution of the points, and
what leaves the task is only what the operator asks for: the k nearest, the
pairs under a threshold, or the spanning forest of the block pair.
"""

from __future__ import annotations

import math
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import check_metric
from ..functions.hashing import hashed_uniform
from ..schema import EDGE_SCHEMA, first_n
from ..scratch import Scratch
from . import grid, kernels, pivots

BLOCK_ROWS = 4096  # blocks whose forest is grown, or whose pairs all leave
NEAR_ROWS = 16_384  # blocks of which only near pairs leave
MAX_PIECES = 8  # of BLOCK_ROWS that a block of a large table has, so that its points are sent to fewer tasks
LEAST_BLOCKS = 16  # blocks that a table is cut into before they have several pieces
MAX_TASKS = 20_000
FIRST_IDS = 16  # smallest ids whose pairs are made first
GRID_ROWS = 50_000
PIVOT_ROWS = 50_000

EDGE_ARROW = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64())])


def _edge_batch(src, dst, w) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(src), pa.int64()),
            pa.array(np.asarray(dst), pa.int64()),
            pa.array(np.asarray(w), pa.float64(), from_pandas=True),
        ],
        schema=EDGE_ARROW,
    )


def block_layout(rows: int, cores: int, block_rows: int = BLOCK_ROWS) -> int:
    """Number of blocks: bounded block size, and enough block pairs to use every core."""
    by_size = math.ceil(rows / block_rows)
    by_cores = math.ceil(math.sqrt(2 * cores)) if rows > 256 else 1
    return max(1, by_size, by_cores)


def _block_pairs(vertices: DataFrame, block_rows: int, rows: int | None = None) -> DataFrame:
    """(pair, block, id, features): each vertex once per block pair it takes part in."""
    spark = vertices.sparkSession
    rows = vertices.count() if rows is None else rows
    blocks = block_layout(rows, spark.sparkContext.defaultParallelism, block_rows)
    tasks = min(blocks * (blocks + 1) // 2, MAX_TASKS)
    lo, hi = F.least("block", "_other"), F.greatest("block", "_other")
    placed = (
        vertices.select(
            F.col("id").cast("long").alias("id"),
            F.col("features").cast("array<double>").alias("features"),
            F.expr(f"pmod(xxhash64(id), {blocks}L)").alias("block"),
        )
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        .select(
            (F.shiftright(hi * (hi + 1), 1) + lo).alias("pair"), "block", "id", "features"
        )
    )
    return placed.repartition(tasks, "pair").groupBy("pair")


def _read_group(batches):
    """The one or two blocks of a group as [(ids, matrix), ...], each sorted by id."""
    table = pa.Table.from_batches(list(batches))
    ids = table.column("id").to_numpy()
    block = table.column("block").to_numpy()
    x = kernels.vectors(table.column("features"))
    order = np.argsort(ids, kind="stable")
    ids, block, x = ids[order], block[order], x[order]
    return [(ids[block == b], x[block == b]) for b in np.unique(block)], (ids, x, block)


def _pair_index(pair: int) -> tuple[int, int]:
    hi = (math.isqrt(8 * pair + 1) - 1) // 2
    return pair - hi * (hi + 1) // 2, hi


def all_pairs(
    vertices: DataFrame,
    metric: str = "euclidean",
    threshold: float | None = None,
    block_rows: int | None = None,
    first: int | None = None,
) -> DataFrame:
    """edges: every unordered pair with its distance, or only those within ``threshold``.

    Without a threshold the answer itself has n(n-1)/2 rows; use ``knn``,
    ``eps_join`` or ``complete_forest`` where the pairs are only a means. Who wants no more than the
    ``first`` pairs within ``threshold`` in (src, dst) order gets edges that contain them.
    """
    check_metric(metric)
    if first is not None and threshold is not None:
        some = _first_pairs(vertices, metric, threshold, first)
        if some is not None:
            return some

    def pairs(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = _pair_index(key[0].as_py())
        blocks, _ = _read_group(batches)
        if lo != hi and len(blocks) < 2:
            return
        (ids_a, xa), (ids_b, xb) = blocks[0], blocks[-1]
        if threshold is not None:
            for i, j, w in kernels.near_pairs(xa, xb, metric, np.full(len(ids_a), float(threshold))):
                u, v = ids_a[i], ids_b[j]
                take = slice(None) if lo != hi else u < v
                yield _edge_batch(np.minimum(u, v)[take], np.maximum(u, v)[take], w[take])
            return
        for rows in kernels.row_chunks(len(ids_a), len(ids_b)):
            d = kernels.block_distances(xa[rows], xb, metric)
            take = np.ones(d.shape, dtype=bool) if lo != hi else ids_a[rows, None] < ids_b[None, :]
            i, j = np.nonzero(take)
            u, v = ids_a[rows][i], ids_b[j]
            yield _edge_batch(np.minimum(u, v), np.maximum(u, v), d[i, j])

    if block_rows is None:
        block_rows = BLOCK_ROWS if threshold is None else NEAR_ROWS
    return _block_pairs(vertices, block_rows).applyInArrow(pairs, EDGE_SCHEMA)


def _first_pairs(vertices: DataFrame, metric: str, threshold: float, count: int) -> DataFrame | None:
    """Edges within ``threshold`` that contain the first ``count`` in (src, dst) order.

    The smallest ids meet all vertices; if these pairs are too few, more of the smallest ids do. None for
    small tables and where that many pairs need more ids than a block has.
    """
    rows = vertices.count()
    few = FIRST_IDS
    if rows <= NEAR_ROWS:
        return None
    spark = vertices.sparkSession
    blocks = max(math.ceil(rows / NEAR_ROWS), spark.sparkContext.defaultParallelism)
    every = vertices.select(
        F.col("id").cast("long").alias("id"),
        F.col("features").cast("array<double>").alias("features"),
        F.expr(f"pmod(xxhash64(id), {blocks}L)").alias("block"),
        F.lit(False).alias("small"),
    )

    def pairs(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, x = table.column("id").to_numpy(), kernels.vectors(table.column("features"))
        small = table.column("small").to_numpy()
        lower, upper = (np.flatnonzero(m)[np.argsort(ids[m], kind="stable")] for m in (small, ~small))
        kept = [np.array([], np.int64), np.array([], np.int64), np.array([])]
        bound = np.full(len(lower), float(threshold))
        for i, j, w in kernels.near_pairs(x[lower], x[upper], metric, bound):
            u, v = ids[lower[i]], ids[upper[j]]
            new = u < v
            kept = [np.concatenate([old, c[new]]) for old, c in zip(kept, (u, v, w))]
            order = np.lexsort((kept[1], kept[0]))[:count]
            kept = [c[order] for c in kept]
        yield _edge_batch(*kept)

    scratch = Scratch(spark, "first-pairs")
    while few <= min(NEAR_ROWS, rows // 2):
        top = first_n(every.select("id"), few, "id").agg(F.max("id")).first()[0]
        places = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
        lower = every.where(F.col("id") <= top).select(
            "id", "features", places.alias("block"), F.lit(True).alias("small")
        )
        met = every.unionByName(lower).repartition(min(blocks, MAX_TASKS), "block").groupBy("block")
        found = scratch.store(met.applyInArrow(pairs, EDGE_SCHEMA))
        if found.rows >= count:
            return found.df
        scratch.drop(found)
        few *= 8
    return None


def complete_forest_candidates(
    vertices: DataFrame,
    metric: str = "euclidean",
    block_rows: int = BLOCK_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Spanning forests of all block pairs of the complete graph.

    By the cycle property their union contains the minimum spanning forest of
    the complete graph; it has about n * B rows, and no pair outside it is
    ever written. Blocks of large tables have up to MAX_PIECES pieces of ``block_rows``; a task joins
    the forests of their pairs to one.
    """
    check_metric(metric)
    rows = vertices.count() if rows is None else rows
    pieces = max(1, min(MAX_PIECES, rows // (block_rows * LEAST_BLOCKS)))

    def cut(ids: np.ndarray, x: np.ndarray):
        return [(ids[i : i + block_rows], x[i : i + block_rows]) for i in range(0, len(ids), block_rows)]

    def forest(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = _pair_index(key[0].as_py())
        blocks, (ids, x, block) = _read_group(batches)
        if lo != hi and len(blocks) < 2:
            return
        if pieces == 1:
            side = None if lo == hi else block
            yield _edge_batch(*kernels.dense_forest(ids, x, side, metric))
            return
        left, right = cut(*blocks[0]), cut(*blocks[-1])
        kept = [np.array([], np.int64), np.array([], np.int64), np.array([])]
        for i, (ids_a, xa) in enumerate(left):
            found = [kept]
            if lo == hi:
                found.append(kernels.dense_forest(ids_a, xa, None, metric))
            for ids_b, xb in right[i + 1 :] if lo == hi else right:
                side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
                found.append(kernels.dense_forest(np.r_[ids_a, ids_b], np.concatenate([xa, xb]), side, metric))
            cols = [np.concatenate(c) for c in zip(*found)]
            mask = kernels.forest_mask(*cols)
            kept = [c[mask] for c in cols]
        yield _edge_batch(*kept)

    return _block_pairs(vertices, block_rows * pieces, rows).applyInArrow(forest, EDGE_SCHEMA)


def knn(
    vertices: DataFrame,
    k: int = 5,
    metric: str = "euclidean",
    block_rows: int = NEAR_ROWS,
    grid_rows: int = GRID_ROWS,
    pivot_rows: int = PIVOT_ROWS,
) -> DataFrame:
    """arcs: exact k nearest other vertices; ties by id, the vertex itself excluded by id.

    More than ``grid_rows`` points of up to three dimensions are searched by
    growing grid cells, more than ``pivot_rows`` of more dimensions in the cells of pivots
    that the triangle inequality can't rule out (not for cosine). Otherwise every block pair keeps k neighbours per
    vertex, and the best k of these partial lists are taken. A point with an undefined
    or infinite coordinate has no neighbours and is nobody's neighbour.
    """
    check_metric(metric)
    rows = vertices.count()
    vertices = finite(vertices)
    if rows > min(grid_rows, pivot_rows) and metric in grid.GRID_METRICS:
        dim = dimension(vertices)
        if rows > grid_rows and 0 < dim <= grid.GRID_DIMENSIONS:
            return grid.knn_grid(vertices, k, metric, dim)
        if rows > pivot_rows and dim > grid.GRID_DIMENSIONS:
            return pivots.knn_pivots(vertices, k, metric)[0]

    def nearest(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = _pair_index(key[0].as_py())
        blocks, _ = _read_group(batches)
        if lo != hi:
            if len(blocks) < 2:
                return
            directions = [(blocks[0], blocks[1]), (blocks[1], blocks[0])]
        else:
            directions = [(blocks[0], blocks[0])]
        for (ids_a, xa), (ids_b, xb) in directions:
            same = (ids_a, ids_b) if lo == hi else None
            for i, j, w in kernels.near_pairs(xa, xb, metric, k=k, ids=same):
                yield _edge_batch(ids_a[i], ids_b[j], w)

    partial = _block_pairs(vertices, block_rows, rows).applyInArrow(nearest, EDGE_SCHEMA)
    return k_nearest_per_vertex(partial, k)


def k_nearest_per_vertex(arcs: DataFrame, k: int, tie_seed: int | str | None = None) -> DataFrame:
    """The k lightest arcs of every vertex.

    Equal weights are ordered by ``dst``, or in a seeded random order when
    ``tie_seed`` is given.
    """
    ties = [F.col("dst")]
    if tie_seed is not None:
        ties = [hashed_uniform(tie_seed, "src", "dst"), F.col("dst")]
    order = Window.partitionBy("src").orderBy("w", *ties)
    return (
        arcs.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
        .drop("_rank")
    )


def knn_symmetric(
    vertices: DataFrame, k: int, metric: str = "euclidean", block_rows: int = NEAR_ROWS
) -> DataFrame:
    """arcs: 0.5 * (A + A^T) of the 0/1 nearest-neighbour matrix A."""
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return (
        knn(vertices, k, metric, block_rows)
        .select(F.explode(ends).alias("_e"))
        .groupBy("_e.src", "_e.dst")
        .agg(F.sum(F.lit(0.5)).alias("w"))
    )


def finite(vertices: DataFrame) -> DataFrame:
    """The vertices whose coordinates are all finite numbers."""
    # NaN counts as larger than any number, and a null is not true
    infinity = F.lit(float("inf"))
    return vertices.where(
        F.forall("features", lambda x: F.abs(x.cast("double")) < infinity)
    )


def dimension(vertices: DataFrame) -> int:
    first = vertices.select(F.size("features")).first()
    return 0 if first is None else first[0]


def eps_join(
    vertices: DataFrame,
    eps: float,
    metric: str = "euclidean",
    dim: int | None = None,
    cell_rows: int = grid.CELL_ROWS,
    block_rows: int = NEAR_ROWS,
    pivot_rows: int = PIVOT_ROWS,
) -> DataFrame:
    """edges: pairs within ``eps``.

    In up to three dimensions a grid keeps far pairs from ever meeting, in more the cells
    of pivots do for more than ``pivot_rows`` points (not for cosine); otherwise block
    pairs with a threshold are used. A point with an undefined or infinite
    coordinate is in no pair.
    """
    check_metric(metric)
    vertices = finite(vertices)
    dim = dimension(vertices) if dim is None else dim
    if metric in grid.GRID_METRICS and 0 < dim <= grid.GRID_DIMENSIONS and eps > 0:
        return grid.eps_join_grid(vertices, eps, metric, dim, cell_rows)
    if metric in pivots.METRICS and dim > grid.GRID_DIMENSIONS and vertices.count() > pivot_rows:
        return pivots.eps_join_pivots(vertices, eps, metric)[0]
    return all_pairs(vertices, metric, eps, block_rows)


def limit_edges(edges: DataFrame, max_edges: int | None) -> DataFrame:
    """The first ``max_edges`` edges in (src, dst) order."""
    return edges if max_edges is None else first_n(edges, max_edges, "src", "dst")
