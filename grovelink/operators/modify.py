"""Adding noise to points, deleting vertices and edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hashed_uniform
from ..lookup import DEFAULT_LIMITS, Limits, flags
from ..schema import assign_ids, canonical_edges
from ..scratch import Scratch
from .pairs import dimension

# fixed value: circle radius as a share of the shorter side of the box, halved
CIRCLE_SHARE = 0.7
SHAPES = ("circle", "horizontal_line", "vertical_line")


def _box(vertices: DataFrame) -> tuple[int, int, list[tuple[float, float]]]:
    """Scalars only: count, largest id and the bounds of every coordinate."""
    dim = dimension(vertices)
    bounds = []
    for i in range(max(dim, 0)):
        x = F.col("features")[i]
        bounds += [F.min(x), F.max(x)]
    n, last, *ends = vertices.agg(F.count(F.lit(1)), F.max("id"), *bounds).first()
    return n, last, list(zip(ends[::2], ends[1::2]))


def _append(vertices: DataFrame, last: int, size: int, coordinates: list) -> DataFrame:
    """Noise rows behind the points; their label, if there is one, is NULL."""
    noise = vertices.sparkSession.range(size).select(
        (F.col("id") + F.lit(last + 1)).alias("id"), F.array(*coordinates).alias("features")
    )
    return _points(vertices).unionByName(noise, allowMissingColumns=True)


def _points(vertices: DataFrame) -> DataFrame:
    label = ["label"] if "label" in vertices.columns else []
    return vertices.select(
        "id", F.col("features").cast("array<double>").alias("features"), *label
    )


def add_uniform_noise(vertices: DataFrame, noise: float = 0.1, seed: int | str = 0) -> DataFrame:
    """Append ceil(n * noise) points drawn uniformly from the bounding box of all dimensions."""
    n, last, bounds = _box(vertices)
    if not n:
        return _points(vertices)
    axes = ["x", "y", *range(2, len(bounds))]
    drawn = [
        lo + hashed_uniform(f"{seed}-{axis}", "id") * (hi - lo)
        for axis, (lo, hi) in zip(axes, bounds)
    ]
    return _append(vertices, last, math.ceil(n * noise), drawn)


def add_shape_noise(vertices: DataFrame, shape: str, noise: float = 0.1) -> DataFrame:
    """Append ceil(n * noise) points on a circle or a centre line of the bounding box.

    The points have to be in two dimensions.
    """
    if shape not in SHAPES:
        raise ValueError(f"unknown shape {shape!r}, expected one of {SHAPES}")
    n, last, bounds = _box(vertices)
    if not n:
        return _points(vertices)
    if len(bounds) != 2:
        raise ValueError(f"shapes are drawn in two dimensions, the points have {len(bounds)}")
    size = math.ceil(n * noise)
    (x0, x1), (y0, y1) = bounds
    width, height = x1 - x0, y1 - y0
    cx, cy = (x1 + x0) / 2, (y1 + y0) / 2
    i = F.col("id")
    if shape == "circle":
        radius = min(width, height) * CIRCLE_SHARE / 2
        angle = i * (2 * math.pi / size)
        x, y = F.cos(angle) * radius + cx, F.sin(angle) * radius + cy
    elif shape == "horizontal_line":
        x, y = x0 + i * (width / size), F.lit(cy)
    else:
        x, y = F.lit(cx), y0 + i * (height / size)
    return _append(vertices, last, size, [x, y])


def random_partition(vertices: DataFrame, k: int, seed: int | str = 0) -> DataFrame:
    """(id, u, v): two independent random splits into k parts whose sizes differ by at most 1."""

    def split(name: str) -> DataFrame:
        order = hashed_uniform(f"{seed}-{name}", "id")
        numbered = assign_ids(vertices.select("id").withColumn("_u", order), "_u", "id", id_col="_p")
        return numbered.select("id", F.pmod("_p", F.lit(k)).cast("int").alias(name))

    return split("u").join(split("v"), "id")


def _pick(df: DataFrame, count: int, seed: int | str, *keys: str) -> DataFrame:
    """The ``count`` rows that come first in hash order, found by a distributed sort."""
    drawn = df.select(*keys, hashed_uniform(seed, *keys).alias("_u"))
    return assign_ids(drawn, "_u", *keys, id_col="_p").where(F.col("_p") < count).select(*keys)


def delete_random_vertices(
    vertices: DataFrame,
    arcs: DataFrame,
    fraction: float = 0.01,
    seed: int | str = 0,
    limits: Limits = DEFAULT_LIMITS,
) -> tuple[DataFrame, DataFrame]:
    """Drop ceil(fraction * n) vertices and every arc that touches one of them."""
    scratch = Scratch(vertices.sparkSession, "delete-vertices")
    ids = vertices.select("id")
    gone = scratch.store(_pick(ids, math.ceil(ids.count() * fraction), seed, "id")).df
    kept = vertices.join(gone, "id", "left_anti")
    own = scratch.store(arcs)
    marked = flags(own.df, own.rows, ["src", "dst"], {"gone": gone}, limits)
    return kept, marked.where(~F.col("src_gone") & ~F.col("dst_gone")).select(*arcs.columns)


def delete_random_edges(arcs: DataFrame, fraction: float = 0.01, seed: int | str = 0) -> DataFrame:
    """Drop ceil(fraction * edges) undirected edges, i.e. both of their arcs."""
    pairs = canonical_edges(arcs).select("src", "dst")
    gone = _pick(pairs, math.ceil(pairs.count() * fraction), seed, "src", "dst")
    gone = gone.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    match = (F.least("src", "dst") == F.col("_a")) & (F.greatest("src", "dst") == F.col("_b"))
    return arcs.join(gone, match, "left_anti")
