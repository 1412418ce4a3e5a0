"""Nearest neighbours and threshold pairs of points with many coordinates, by pivots.

A bounded sample of the points serves as pivots; every point belongs to the cell of its
nearest pivot and keeps its distance to it. The triangle inequality bounds the distance of a
query to all points of a cell from below: by the cell's smallest and largest distance to
its pivot, and by half of what the query is nearer to its own pivot than to the cell's. A
query visits the cells that it can't rule out. Small cells are put together in blocks, and a
query is sent once to a block, with the list of the cells it visits there.

For nearest neighbours, the cells of the nearest pivots are searched first; the distance of
the worst neighbour found there is the bound for all others, so the answer is exact. Copies
of a point are folded first. A crowded cell is split into parts, and so are the
queries that visit a block; a task holds one part of each.

What the bounds leave out depends on the points: clusters are told apart, directions without
structure in many dimensions aren't, and then nearly all cells are visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..schema import EDGE_SCHEMA
from ..scratch import Scratch, Stored
from . import kernels

PIVOTS = 1024  # at most; otherwise the square root of the number of points
METRICS = ("euclidean", "manhattan")
FIRST = 3  # cells that are searched before there is a bound
PART_ROWS = 16_384
STEP = 512  # queries that are sent out at once
ROUNDING = 1e-9
HELD = 1 << 20  # pairs that a task gathers before it hands them on or cuts them down


@dataclass
class Cells:
    """points(id, features, cell, away), their pivots, and per cell the number of points and
    their smallest and largest distance to the pivot."""

    points: Stored
    pivots: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    metric: str


@dataclass
class Visits:
    """sent(block, id, features, bound, cells): each query once per block of cells that it visits;
    per block the parts of its entries and the number of its queries; pairs in the visited cells."""

    sent: DataFrame
    blocks: dict[int, tuple[int, int]]
    pairs: int


def _blocks(size: np.ndarray, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell its block and the block's number of parts: following cells share a block as long as it
    holds no more than ``part_rows`` points; a cell that is larger has its own, in parts."""
    block, parts = np.zeros(len(size), np.int64), np.maximum(1, -(-size // part_rows))
    held = number = 0
    for c, n in enumerate(size.tolist()):
        if c and held + n > part_rows:
            held, number = 0, number + 1
        block[c], held = number, held + n
    return block, parts


def _cells(scratch: Scratch, points: DataFrame, rows: int, metric: str, most: int) -> Cells:
    wanted = max(1, min(most, math.isqrt(rows)))
    sample = points.select("id", "features").orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow()
    pivots = kernels.vectors(sample.column("features"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = kernels.block_distances(kernels.vectors(batch.column(1)), pivots, metric)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])],
                names=["id", "features", "cell", "away"],
            )

    kind = "id long, features array<double>, cell int, away double"
    stored = scratch.store(points.select("id", "features").mapInArrow(assign, kind))
    size, low, high = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    told = stored.df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
    for r in told.collect():  # one row per pivot
        size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    return Cells(stored, pivots, size, low, high, metric)


def _visits(cells: Cells, queries: DataFrame, first: int | None, skip: int = 0, part_rows: int = PART_ROWS) -> Visits:
    """The cells that queries(id, features, bound) have to visit, those of a block together:
    the ``first`` nearest ones, or all within ``bound`` but the ``skip`` nearest."""
    pivots, size, low, high, metric = cells.pivots, cells.size, cells.low, cells.high, cells.metric
    start, parts = _blocks(size, part_rows)
    blocks = np.unique(start[size > 0])

    def taken(x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        d = kernels.block_distances(x, pivots, metric)
        rank = np.argsort(np.argsort(np.where(size > 0, d, np.inf), axis=1, kind="stable"), axis=1)
        if first is not None:
            return (rank < first) & (size > 0)
        own = d.min(axis=1, keepdims=True)
        least = np.maximum(np.maximum(d - high, low - d), (d - own) / 2)
        return (least - ROUNDING * (d + high) <= bound[:, None]) & (size > 0) & (rank >= skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):  # a query goes to many blocks
                batch = whole.slice(at, STEP)
                take = taken(kernels.vectors(batch.column(1)), batch.column(2).to_numpy())
                for block in blocks:
                    mine = np.flatnonzero(start == block)
                    rows = np.flatnonzero(take[:, mine].any(axis=1))
                    if len(rows):
                        row, cell = np.nonzero(take[np.ix_(rows, mine)])
                        ends = np.searchsorted(row, np.arange(len(rows) + 1))
                        lists = pa.ListArray.from_arrays(
                            pa.array(ends.astype(np.int32)), pa.array(mine[cell].astype(np.int32))
                        )
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), block, np.int32)), *(c.take(pa.array(rows)) for c in batch.columns), lists],
                            names=["block", "id", "features", "bound", "cells"],
                        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries per block and pairs in the visited cells."""
        asked, met = dict.fromkeys(blocks.tolist(), 0), 0
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                take = taken(kernels.vectors(batch.column(0)), batch.column(1).to_numpy())
                met += int((take * size).sum())
                for block in asked:
                    asked[block] += int(take[:, start == block].any(axis=1).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*asked, -1], pa.int32()), pa.array([*asked.values(), met], pa.int64())], names=["block", "n"]
        )

    counted = queries.select("features", "bound").mapInArrow(count, "block int, n long").groupBy("block").agg(F.sum("n").alias("n"))
    asked = {r["block"]: r["n"] for r in counted.collect()}  # one row per block
    met = asked.pop(-1, 0)
    sent = queries.select("id", "features", "bound").mapInArrow(
        run, "block int, id long, features array<double>, bound double, cells array<int>"
    )
    return Visits(sent, {b: (int(parts[start == b].max()), n) for b, n in asked.items() if n}, met)


def _search(cells: Cells, visits: Visits, k: int | None, part_rows: int) -> DataFrame:
    """(src, dst, w) of queries and entries within the bound, at most ``k`` of each part of a
    block. Without ``k``: pairs with src < dst."""
    spark, metric = cells.points.df.sparkSession, cells.metric
    start, _ = _blocks(cells.size, part_rows)
    told = [(b, entries, -(-n // part_rows)) for b, (entries, n) in sorted(visits.blocks.items())]
    table = F.broadcast(spark.createDataFrame(told or [(-1, 1, 1)], "block int, entries long, asked long"))

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = visits.sent.join(table, "block").withColumn("p", every("entries"))
    left = left.select("block", "p", F.expr("pmod(xxhash64(id), asked)").alias("q"), "id", "features", "bound", "cells")
    block_of = F.get(F.lit([int(b) for b in start]), F.col("cell")).cast("int").alias("block")
    right = cells.points.df.select(block_of, "cell", "id", "features").join(table, "block").withColumn("q", every("asked"))
    right = right.select("block", F.expr("pmod(xxhash64(id), entries)").alias("p"), "q", "cell", "id", "features")

    def batch(q_ids, ids, found) -> pa.RecordBatch:
        i, j, w = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(w)], names=["src", "dst", "w"])

    def best(ids, found):
        i, j, w = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((ids[j], w, i))
        order = order[kernels.places_in_groups(i[order]) < k]
        return i[order], j[order], w[order]

    def run(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        mine, theirs = (both.filter(side) for side in (pc.is_null(both["cell"]), pc.is_valid(both["cell"])))
        if not (mine.num_rows and theirs.num_rows):
            return
        theirs = theirs.sort_by([("cell", "ascending"), ("id", "ascending")])
        ids, x, cell = theirs.column("id").to_numpy(), kernels.vectors(theirs.column("features")), theirs.column("cell").to_numpy()
        q_ids, q, bound = mine.column("id").to_numpy(), kernels.vectors(mine.column("features")), mine.column("bound").to_numpy()
        lists = mine.column("cells").combine_chunks()
        asking = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        asked = lists.flatten().to_numpy()
        order = np.argsort(asked, kind="stable")
        asking, asked = asking[order], asked[order]
        found, held = [], 0
        for c in np.unique(cell):
            at = np.searchsorted(cell, c, "left")
            rows = asking[np.searchsorted(asked, c, "left") : np.searchsorted(asked, c, "right")]
            there = x[at : np.searchsorted(cell, c, "right")]
            for i, j, w in kernels.near_pairs(q[rows], there, metric, bound[rows], k):
                i, j = rows[i], j + at
                if k is None:
                    apart = q_ids[i] < ids[j]
                    i, j, w = i[apart], j[apart], w[apart]
                found.append((i, j, w))
                held += len(i)
                if held > HELD:
                    if k is None:
                        yield batch(q_ids, ids, found)
                        found = []
                    else:
                        found = [best(ids, found)]
                    held = 0
        if found:
            yield batch(q_ids, ids, found if k is None else [best(ids, found)])

    keys = ("block", "p", "q")
    met = left.unionByName(right, allowMissingColumns=True).groupBy(*keys)
    return met.applyInArrow(run, EDGE_SCHEMA)


def knn_pivots(
    vertices: DataFrame,
    k: int,
    metric: str = "euclidean",
    most_pivots: int = PIVOTS,
    part_rows: int = PART_ROWS,
    limits: Limits = DEFAULT_LIMITS,
) -> tuple[DataFrame, dict]:
    """arcs: exact k nearest other vertices, ties by id; and the pairs in the visited cells.

    ``vertices`` have finite coordinates. Of equal points only the k + 1 smallest ids can be an
    answer, and all of them share one search.
    """
    scratch = Scratch(vertices.sparkSession, "pivots")
    plain = vertices.select(
        F.col("id").cast("long").alias("id"), F.transform("features", lambda v: v.cast("double")).alias("features")
    )
    copy = F.row_number().over(Window.partitionBy("features").orderBy("id"))
    kept = scratch.store(
        plain.withColumn("copy", copy).where(F.col("copy") <= k + 1),
        places=F.sum((F.col("copy") == 1).cast("long")),
    )
    places = kept.metrics["places"] or 0
    if not places:
        return plain.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w")), {"pairs": 0}
    cells = _cells(scratch, kept.df, kept.rows, metric, most_pivots)
    asking = kept.df.where("copy = 1").select("id", "features", F.lit(float("inf")).alias("bound"))
    nearest = _visits(cells, asking, FIRST, part_rows=part_rows)
    near = scratch.store(_search(cells, nearest, k + 1, part_rows))
    order = Window.partitionBy("src").orderBy("w", "dst")

    def best(arcs: DataFrame) -> DataFrame:
        return arcs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1)

    bound = best(near.df).where(F.col("_rank") == k + 1).select(F.col("src").alias("id"), F.col("w").alias("worst"))
    again = asking.join(bound, "id", "left").select("id", "features", F.coalesce("worst", "bound").alias("bound"))
    asked = scratch.store(again)
    others = _visits(cells, asked.df, None, FIRST, part_rows)
    more = _search(cells, others, k + 1, part_rows)
    lists = best(near.df.unionByName(more)).groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("w", "dst"))).alias("near")
    )
    answers = scratch.store(lists.join(asking, F.col("src") == F.col("id")).select(F.col("features").alias("id"), "near"))
    # a list of k + 1 neighbours is that many times wider than a two-column row
    narrow = Limits(limits.broadcast_rows // (k + 2), limits.pointer_rows, limits.finish_edges, limits.heavy_share)
    everyone = scratch.store(plain.select(F.col("id").alias("src"), F.col("features").alias("_at")))
    told = lookup(everyone.df, everyone.rows, "_at", answers.df, places, {"near": "near"}, narrow)
    near_by = F.slice(F.filter("near", lambda e: e["dst"] != F.col("src")), 1, k)
    arcs = told.select("src", F.explode(near_by).alias("_n")).select(
        "src", F.col("_n.dst").alias("dst"), F.col("_n.w").alias("w")
    )
    return arcs, {"places": places, "pivots": len(cells.pivots), "pairs": nearest.pairs + others.pairs}


def eps_join_pivots(
    vertices: DataFrame,
    eps: float,
    metric: str = "euclidean",
    most_pivots: int = PIVOTS,
    part_rows: int = PART_ROWS,
) -> tuple[DataFrame, dict]:
    """edges: the pairs within ``eps``; and the pairs in the visited cells.

    ``vertices`` have finite coordinates.
    """
    scratch = Scratch(vertices.sparkSession, "pivots")
    plain = scratch.store(
        vertices.select(
            F.col("id").cast("long").alias("id"), F.transform("features", lambda v: v.cast("double")).alias("features")
        )
    )
    if not plain.rows:
        return plain.df.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w")), {"pairs": 0}
    cells = _cells(scratch, plain.df, plain.rows, metric, most_pivots)
    asking = cells.points.df.select("id", "features", F.lit(float(eps)).alias("bound"))
    visits = _visits(cells, asking, None, part_rows=part_rows)
    return _search(cells, visits, None, part_rows), {"pivots": len(cells.pivots), "pairs": visits.pairs}
