"""Spectral embedding of a graph by block Lanczos on tables.

The wanted vectors are the leading ones of M = D^-1/2 W D^-1/2, that is those of the smallest
eigenvalues of the normalised Laplacian I - M. Basis vectors are arrays in a table with one
row per vertex. One step multiplies the newest block of columns by M (a join of the arcs with
that block and a sum per vertex) and makes the product orthogonal to all columns before it, twice if
little is left of it. Only inner products of columns reach the driver, a few hundred numbers; vectors never do. When the
basis is full its best vectors stay and it grows on from them (thick restart), until the residuals
are below the tolerance. A graph of few arcs goes the same way inside one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hashed_uniform
from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..scratch import Scratch, Stored
from .compare import kmeans
from .pairs import knn_symmetric
from .perturbed import draws

# of the basis, unless eight times the block is more
MOST_COLUMNS = 40
MOST_PAIRS = 30
# part of a product that counts as nothing new, as a share of its squared length
NOTHING_NEW = 1e-12
# part from which on cleaning once is enough
MUCH_LEFT = 1e-3
# shorter residuals are not told from rounding
LEAST_TOLERANCE = 2e-7


@dataclass
class Embedding:
    """vectors(id, features ARRAY<DOUBLE>); the eigenvalues of the normalised Laplacian in
    ascending order; per pair the length of its residual."""

    vectors: DataFrame
    values: list[float]
    residuals: list[float]


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _arrays(x: np.ndarray) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))


class _Columns:
    """An orthonormal basis and newer columns, a row per vertex in a table."""

    def __init__(self, scratch: Scratch, matrix: Stored, points: Stored, seed: int, block: int, limits: Limits):
        self.scratch, self.matrix, self.vertices = scratch, matrix, points.rows
        # a broadcast table is bounded by its width as well
        self.limits = Limits(limits.broadcast_rows // block, limits.pointer_rows, limits.finish_edges, limits.heavy_share)
        start = F.array(*[hashed_uniform(seed, F.lit(i), "id") - 0.5 for i in range(block)])
        self.table = points.df.select("id", F.array().cast("array<double>").alias("basis"), start.alias("new"))
        self.held, self.width, self.change = None, (0, block), (None, None)

    def changed(self, products: bool = False) -> DataFrame:
        """The table with what ``combine`` asked for; ``products``: a row more per task, with inner products."""
        (old, new), (kept, made) = self.width, self.change

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, names = 0.0, ["id", "basis", "new", "products"]
            kind = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, kind = batch.column("id"), batch.schema.field("id").type
                basis, newer = _rows_of(batch.column("basis"), old), _rows_of(batch.column("new"), new)
                if made is not None:
                    newer = np.hstack([basis, newer]) @ made
                if kept is not None:
                    basis = basis @ kept
                if products:
                    total = total + np.hstack([basis, newer]).T @ newer
                none = pa.nulls(len(ids), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids, _arrays(basis), _arrays(newer), none], names=names)
            if products and kind is not None:
                none = pa.nulls(1, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), none, none, _arrays(total.reshape(1, -1))], names=names)

        if not products and kept is None and made is None:
            return self.table
        doubles, kind = "array<double>", self.table.schema["id"].dataType.simpleString()
        return self.table.select("id", "basis", "new").mapInArrow(
            run, f"id {kind}, basis {doubles}, new {doubles}, products {doubles}"
        )

    def _settle(self) -> None:
        (old, new), (kept, made) = self.width, self.change
        self.width = old if kept is None else kept.shape[1], new if made is None else made.shape[1]
        self.change = (None, None)

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of the newer columns with the basis, and with each other."""
        stored = self.scratch.store(self.changed(products=True))
        self.scratch.drop(self.held)
        self._settle()
        self.table, self.held = stored.df.where("products is null").select("id", "basis", "new"), stored
        parts = [r[0] for r in stored.df.where("products is not null").select("products").collect()]
        old, new = self.width
        total = np.sum(parts, axis=0).reshape(old + new, new) if parts else np.zeros((old + new, new))
        return total[:old], total[old:]

    def combine(self, kept: np.ndarray | None, made: np.ndarray) -> None:
        """The newer columns become sums of all there are, and with ``kept`` the basis sums of its own."""
        self.change = (kept, made)

    def vectors(self, weights: np.ndarray) -> DataFrame:
        """(id, basis): sums of the basis, as it is after the change asked for."""
        kept = self.change[0]
        self.change = (weights if kept is None else kept @ weights, np.zeros((sum(self.width), 0)))
        return self.changed()

    def multiply(self) -> None:
        """The newer columns join the basis; their products with the matrix are the new ones."""
        table = self.changed()
        self._settle()
        old, new = self.width
        met = lookup(self.matrix.df, self.matrix.rows, "dst", table.select("id", "new"), self.vertices, {"new": "_new"}, self.limits)
        product = met.groupBy(F.col("src").alias("id")).agg(
            *[F.sum(F.col("w") * F.col("_new")[i]).alias(f"y_{i}") for i in range(new)]
        )
        self.table = table.join(product, "id", "left").select(
            "id",
            F.concat("basis", "new").alias("basis"),
            F.array(*[F.coalesce(f"y_{i}", F.lit(0.0)) for i in range(new)]).alias("new"),
        )
        self.width = old + new, new


class _Arrays:
    """The same for arcs that one task holds; every vertex is a ``src``."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, seed: int, block: int):
        order = np.lexsort((dst, src))
        self.ids, self.first = np.unique(src[order], return_index=True)
        self.dst, self.w = np.searchsorted(self.ids, dst[order]), w[order]
        self.basis = np.zeros((len(self.ids), 0))
        self.new = np.stack([draws(seed, np.full(len(self.ids), i), self.ids) - 0.5 for i in range(block)], axis=1)

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        return self.basis.T @ self.new, self.new.T @ self.new

    def combine(self, kept: np.ndarray | None, made: np.ndarray) -> None:
        self.new = np.hstack([self.basis, self.new]) @ made
        self.basis = self.basis if kept is None else self.basis @ kept

    def multiply(self) -> None:
        products = [np.add.reduceat(self.w * x[self.dst], self.first) for x in self.new.T]
        self.basis, self.new = np.hstack([self.basis, self.new]), np.stack(products, axis=1)


def _cleaned(along: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights that make of the newer columns orthonormal ones that are orthogonal to the basis.

    False where so little is left that rounding shows, and the columns have to be cleaned again.
    """
    length, turn = np.linalg.eigh(own - along.T @ along)
    largest = max(own.diagonal().max(initial=0.0), 1e-300)
    keep = length > NOTHING_NEW * largest
    mix = turn[:, keep] / np.sqrt(length[keep])
    return np.vstack([-along @ mix, mix]), bool(np.all(length > MUCH_LEFT * largest))


def _eigenpairs(
    space: _Columns | _Arrays, k: int, block: int, tolerance: float, restarts: int | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, the weights of their vectors in ``space.basis``, the residuals.

    The projected matrix tells when they are near enough; then the vectors are made orthonormal and
    multiplied once more, which gives the residuals themselves. Where rounding has made these longer, the vectors
    are a new start.
    """
    most = max(MOST_COLUMNS, 8 * block)
    tolerance = max(tolerance, LEAST_TOLERANCE)
    turns, checking, before = 0, False, np.inf
    whole, kept, (made, clean) = np.zeros((0, 0)), None, _cleaned(*space.products())
    while True:
        space.combine(kept, made)
        kept, fresh = None, made.shape[1]
        if fresh and not clean:
            made, _ = _cleaned(*space.products())
            fresh = made.shape[1]
            space.combine(None, made)
        if fresh:
            space.multiply()
            along, own = space.products()
            rest, (made, clean) = own - along.T @ along, _cleaned(along, own)
            inner, whole = whole, np.zeros((len(along), len(along)))
            whole[: len(inner), : len(inner)] = inner
            whole[:, len(inner) :] = along
            whole[len(inner) :, :] = along.T
        if fresh and not checking and len(whole) + block <= most:
            continue
        value, vector = np.linalg.eigh(whole)
        value, vector = value[::-1], vector[:, ::-1]
        found = min(k, len(value))
        last = vector[len(vector) - fresh :, :found]
        squares = np.einsum("ij,ik,kj->j", last, rest, last) if fresh else np.zeros(found)
        residuals = np.sqrt(np.maximum(squares, 0.0))
        worst = residuals.max(initial=0.0)
        if not found or not fresh or (checking and (worst <= tolerance or 2.0 * worst > before)):
            break
        before = worst if checking else before
        if checking:
            checking = False
        elif worst <= 0.9 * tolerance:
            checking = True
            start = vector[:, : min(block, len(vector))]
            kept, whole, clean = np.zeros((len(vector), 0)), np.zeros((0, 0)), False
            made = np.vstack([start, np.zeros((len(along.T), start.shape[1]))])
        elif restarts is not None and turns >= restarts:
            break
        else:
            turns += 1
            stay = min(found + 2 * block + 2, len(vector) - 1)
            kept, whole = vector[:, :stay], np.diag(value[:stay])
    return value[:found], vector[:, :found], residuals


def _in_one_task(matrix: DataFrame, k: int, block: int, tolerance: float, restarts: int | None, seed: int) -> DataFrame:
    """(id, at, value, residual): the vectors; the first row has the eigenvalues and residuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "w"))
        space = _Arrays(src, dst, w, seed, block)
        value, vector, residuals = _eigenpairs(space, k, block, tolerance, restarts)
        rows = (space.basis @ vector).tolist()
        doubles = pa.list_(pa.float64())
        told = [pa.array([x.tolist()] + [None] * (len(rows) - 1), doubles) for x in (value, residuals)]
        yield pa.RecordBatch.from_arrays([pa.array(space.ids), pa.array(rows, doubles), *told], names=["id", "at", "value", "residual"])

    doubles = "array<double>"
    kind = matrix.schema["src"].dataType.simpleString()
    return matrix.coalesce(1).mapInArrow(run, f"id {kind}, at {doubles}, value {doubles}, residual {doubles}")


def spectral_embedding(
    arcs: DataFrame,
    vertices: DataFrame,
    k: int = 3,
    tolerance: float = 1e-6,
    restarts: int | None = None,
    seed: int = 0,
    limits: Limits = DEFAULT_LIMITS,
) -> Embedding:
    """The ``k`` smallest eigenpairs of the normalised Laplacian of symmetric ``arcs``.

    Weights are positive; arcs with a null, NaN, infinite, zero or negative weight, and those of unknown
    vertices, are left out. A vertex without arcs is a component of its own (eigenvalue 0). Vectors are divided
    by the root of the degree, so they are constant on a component; their signs, and a
    rotation among equal eigenvalues, are free. Fewer than ``k`` vertices give as many pairs. It ends when no
    residual is above ``tolerance``, or before that after ``restarts``, if given.
    """
    block = k + 2
    if not 1 <= k <= MOST_PAIRS:
        raise ValueError(f"k must be between 1 and {MOST_PAIRS}")
    scratch = Scratch(arcs.sparkSession, "spectral")
    ids = vertices.select("id").distinct()
    good = arcs.select("src", "dst", "w").where("w > 0 and w < double('infinity')")
    for end in ("src", "dst"):
        good = good.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    links = scratch.store(good)
    degrees = links.df.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))
    points = scratch.store(
        ids.join(degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree")),
        unnamed=F.sum(F.col("id").isNull().cast("long")),
    )
    scaled = links.df.select("src", "dst", "w")
    for end in ("src", "dst"):
        scaled = lookup(scaled, links.rows, end, points.df, points.rows, {"degree": f"{end}_d"}, limits)
    alone = points.df.where("degree = 0").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    matrix = scratch.store(
        scaled.select("src", "dst", (F.col("w") / F.sqrt(F.col("src_d") * F.col("dst_d"))).alias("w")).unionByName(alone)
    )
    if not points.rows:
        return Embedding(points.df.select("id", F.array().cast("array<double>").alias("features")), [], [])
    root = F.when(F.col("degree") > 0, F.sqrt("degree")).otherwise(F.lit(1.0))
    if matrix.rows <= limits.finish_edges and not points.metrics["unnamed"]:
        done = scratch.store(_in_one_task(matrix.df, k, block, tolerance, restarts, seed), small=True)
        value, residuals = done.df.where("value is not null").select("value", "residual").first()
        at, vectors = done.df, F.transform("at", lambda x: x / root)
    else:
        space = _Columns(scratch, matrix, points, seed, block, limits)
        value, vector, residuals = _eigenpairs(space, k, block, tolerance, restarts)
        value, residuals = value.tolist(), residuals.tolist()
        at, vectors = space.vectors(vector), F.transform("basis", lambda x: x / root)
    found = scratch.store(at.join(points.df, "id").select("id", vectors.alias("features")))
    return Embedding(found.df, [1.0 - x for x in value], list(residuals))


def spectral_clusters(vertices: DataFrame, k: int = 3, neighbours: int = 10, seed: int = 0) -> DataFrame:
    """(id, cluster): k-means on the spectral embedding of the symmetric neighbour graph."""
    found = spectral_embedding(knn_symmetric(vertices, neighbours), vertices, k, seed=seed)
    return kmeans(found.vectors, k, seed)
