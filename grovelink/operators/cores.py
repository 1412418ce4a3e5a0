"""Core distances: how far the smallest ball around a point reaches that holds enough points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..scratch import Scratch, Stored
from .pairs import finite, knn

# fixed value: neighbours (with itself) a point needs to be a core point by default
DBSCAN_MIN_POINTS = 5


def core_distances(
    vertices: DataFrame,
    min_points: int = DBSCAN_MIN_POINTS,
    metric: str = "euclidean",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """(id, features, weight, core) per distinct point, named by its smallest id.

    ``core`` is the smallest radius that holds ``min_points`` points, itself and copies included;
    NULL if there are too few. Points with an undefined or infinite coordinate are left out.
    """
    return near_places(vertices, min_points, metric, limits)[0]


def near_places(
    vertices: DataFrame,
    min_points: int = DBSCAN_MIN_POINTS,
    metric: str = "euclidean",
    limits: Limits = DEFAULT_LIMITS,
    named: bool = False,
) -> tuple[DataFrame, Stored | None]:
    """``core_distances`` and the arcs to the ``min_points`` - 1 nearest places, if they were needed.

    With ``named`` only of places that have an id.
    """
    if min_points < 1:
        raise ValueError("min_points must be positive")
    scratch = Scratch(vertices.sparkSession, "cores")
    points = finite(vertices).select(
        F.col("id").cast("long").alias("id"), F.transform("features", lambda x: x.cast("double")).alias("features")
    )
    folded = points.groupBy("features").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    places = scratch.store(folded.where("id is not null") if named else folded)
    enough = F.col("weight") >= min_points
    if min_points == 1 or not places.rows:
        return places.df.select("id", "features", "weight", F.when(enough, F.lit(0.0)).alias("core")), None
    # each neighbour weighs one point at least, so so many places are enough
    near = scratch.store(knn(places.df.select("id", "features"), min_points - 1, metric))
    told = lookup(near.df, near.rows, "dst", places.df, places.rows, {"weight": "n"}, limits)
    order = Window.partitionBy("src").orderBy("w", "dst").rowsBetween(Window.unboundedPreceding, 0)
    counted = told.select(F.col("src").alias("id"), "w", F.sum("n").over(order).alias("_met"))
    reached = counted.join(places.df.select("id", "weight"), "id").groupBy("id").agg(
        F.min(F.when(F.col("weight") + F.col("_met") >= min_points, F.col("w"))).alias("_core")
    )
    cores = places.df.join(reached, "id", "left").select(
        "id", "features", "weight", F.when(enough, F.lit(0.0)).otherwise(F.col("_core")).alias("core")
    )
    return cores, near
