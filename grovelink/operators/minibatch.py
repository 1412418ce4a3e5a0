"""k-means by small batches: each step moves the centres by the points of one hashed batch.

A centre weighs as many points as it has taken so far, so later batches move it less. The
batches of all steps are drawn in one pass and stored; a step reads its own rows and
sends k sums per coordinate to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hashed_uniform
from ..scratch import Scratch
from . import kernels
from .pairs import finite


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre per row; ties to the lower one."""
    out = np.empty(len(x), np.int64)
    for rows in kernels.row_chunks(len(x), len(centres)):
        out[rows] = kernels.block_distances(x[rows], centres, "euclidean").argmin(axis=1)
    return out


def _moved(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centre the sum and the number of the points that are nearest to it."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = kernels.vectors(batch.column(0))
            near = _nearest(x, centres)
            np.add.at(sums, near, x)
            counts += np.bincount(near, minlength=len(centres))
        centre, place = np.indices(centres.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(centre), pa.array(place), pa.array(sums.ravel()), pa.array(np.repeat(counts, centres.shape[1]))],
            names=["centre", "place", "total", "n"],
        )

    told = (
        points.select("features")
        .mapInArrow(partial, "centre long, place long, total double, n long")
        .groupBy("centre", "place")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )
    sums, counts = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
    for r in told.collect():  # k rows per coordinate
        sums[r["centre"], r["place"]] = r["total"]
        counts[r["centre"]] = r["n"]
    return sums, counts


def minibatch_centres(vertices: DataFrame, k: int = 3, batch: int = 1024, steps: int = 20, seed: int = 0) -> np.ndarray:
    """The centres after ``steps`` batches of ``batch`` points on average.

    They start as the ``k`` points with the smallest hashed draw (all, if there are fewer).
    A point with an undefined or infinite coordinate takes no part.
    """
    if k < 1 or batch < 1 or steps < 0:
        raise ValueError("k and batch must be positive, steps not negative")
    points = finite(vertices).select("id", F.transform("features", lambda v: v.cast("double")).alias("features"))
    n = points.count()
    first = points.orderBy(hashed_uniform(seed, F.lit(0), "id"), "id").limit(k).collect()
    centres = np.array([r["features"] for r in first], dtype=np.float64)
    if not n or not steps or not centres.size:
        return centres
    turns = F.filter(
        F.sequence(F.lit(1), F.lit(steps)), lambda t: hashed_uniform(seed, t, "id") < F.lit(batch / n)
    )
    scratch = Scratch(vertices.sparkSession, "minibatch")
    drawn = scratch.store(points.select("features", F.explode(turns).alias("step")))
    weight = np.zeros(len(centres), np.int64)
    for step in range(1, steps + 1):
        sums, counts = _moved(drawn.df.where(F.col("step") == step), centres)
        met = counts > 0
        total = (weight + counts)[met, None]
        centres[met] = (centres[met] * weight[met, None] + sums[met]) / total
        weight += counts
    scratch.drop(drawn)
    return centres


def minibatch_kmeans(
    vertices: DataFrame, k: int = 3, batch: int = 1024, steps: int = 20, seed: int = 0
) -> DataFrame:
    """(id, cluster): index of the nearest centre; -1 for a point with an undefined coordinate."""
    centres = minibatch_centres(vertices, k, batch, steps, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(kernels.vectors(batch.column(1)), centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32))], names=["id", "cluster"])

    points = vertices.select(
        F.col("id").cast("long").alias("id"), F.transform("features", lambda v: v.cast("double")).alias("features")
    )
    known = finite(points)
    rest = points.join(known.select("id"), "id", "left_anti").select("id", F.lit(-1).alias("cluster"))
    return known.mapInArrow(assign, "id long, cluster int").unionByName(rest)
