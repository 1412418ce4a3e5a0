"""Other clusterers on the same vertices table, for comparison."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookup import DEFAULT_LIMITS, Limits, flags, lookup
from ..scratch import Scratch
from . import planar
from .components import connected_components
from .cores import DBSCAN_MIN_POINTS, near_places
from .forest import PLANAR_ROWS
from .grid import GRID_METRICS
from .pairs import dimension, eps_join, finite, knn_symmetric


def _vectors(vertices: DataFrame) -> DataFrame:
    return vertices.select("id", array_to_vector(F.col("features")).alias("_v"))


def kmeans(vertices: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """(id, cluster) of seeded k-means."""
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(
        _vectors(vertices)
    )
    return model.transform(_vectors(vertices)).select("id", "cluster")


def gaussian_mixture(vertices: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """(id, cluster) of a full-covariance Gaussian mixture."""
    model = GaussianMixture(
        k=k, seed=seed, featuresCol="_v", predictionCol="cluster", probabilityCol="_p"
    ).fit(_vectors(vertices))
    return model.transform(_vectors(vertices)).select("id", "cluster")


def spectral(vertices: DataFrame, k: int = 3, neighbours: int = 10, rounds: int = 20) -> DataFrame:
    """(id, cluster) by power iteration on the symmetric neighbour graph.

    Power iteration approximates the spectral embedding with one vector.
    """
    graph = knn_symmetric(vertices, neighbours).where(F.col("src") < F.col("dst"))
    pic = PowerIterationClustering(k=k, maxIter=rounds, weightCol="w", initMode="degree")
    return pic.assignClusters(graph).select("id", "cluster")


def _end(own: str, n: str) -> Column:
    return F.struct(F.col(own).alias("id"), F.col(n).alias("n"))


def dbscan(
    vertices: DataFrame,
    eps: float,
    min_points: int = DBSCAN_MIN_POINTS,
    metric: str = "euclidean",
    limits: Limits = DEFAULT_LIMITS,
    planar_rows: int = PLANAR_ROWS,
) -> DataFrame:
    """(id, cluster): density clusters named by their smallest core id, noise is -1.

    A core point has at least ``min_points`` points (itself included) within
    ``eps``; a border point joins the smallest cluster among its core
    neighbours. A point with an undefined or infinite coordinate is noise. Copies
    of a point are first folded into one weighted point, so a large group of
    copies costs one row instead of all its pairs. Of more than ``planar_rows`` points in two or
    three dimensions the pairs within ``eps`` aren't made either: core distances tell the core
    points, their spanning tree what is connected.
    """
    scratch = Scratch(vertices.sparkSession, "dbscan")
    total = vertices.count()
    if total > planar_rows and metric in GRID_METRICS and min_points > 0 and eps > 0:
        dim = dimension(finite(vertices))
        if dim in planar.CURVE_BITS:
            return _dbscan_planar(scratch, vertices, total, eps, min_points, metric, dim, limits)
    places = scratch.store(
        vertices.groupBy("features").agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")
        )
    )
    near = scratch.store(eps_join(places.df.select("id", "features"), eps, metric))
    pairs = near.df.select("src", "dst")
    for end in ("src", "dst"):
        value = {"weight": f"{end}_n"}
        pairs = lookup(pairs, near.rows, end, places.df, places.rows, value, limits)
    around = (
        pairs.select(F.explode(F.array(_end("src", "dst_n"), _end("dst", "src_n"))).alias("_e"))
        .groupBy(F.col("_e.id").alias("id"))
        .agg(F.sum("_e.n").alias("_n"))
    )
    core = scratch.store(
        places.df.join(around, "id", "left")
        .where(F.col("weight") + F.coalesce("_n", F.lit(0)) >= min_points)
        .transform(finite)
        .select("id")
    )
    marked = flags(near.df.select("src", "dst"), near.rows, ["src", "dst"], {"core": core.df}, limits)
    marked = scratch.store(marked.where("src_core or dst_core"))
    links = marked.df.where("src_core and dst_core")
    comps = scratch.store(connected_components(links, core.df, limits))
    one_core = marked.df.where("not (src_core and dst_core)").select(
        F.when(F.col("src_core"), F.col("dst")).otherwise(F.col("src")).alias("id"),
        F.when(F.col("src_core"), F.col("src")).otherwise(F.col("dst")).alias("core"),
    )
    value = {"comp": "comp"}
    border = (
        lookup(one_core, marked.rows, "core", comps.df, comps.rows, value, limits)
        .groupBy("id")
        .agg(F.min("comp").alias("comp"))
    )
    placed = scratch.store(
        places.df.select("id", "features")
        .join(comps.df.unionByName(border), "id", "left")
        .select("id", "features", F.coalesce("comp", F.lit(-1).cast("long")).alias("cluster"))
    )
    if placed.rows == total:
        return placed.df.select("id", "cluster")
    by_place = placed.df.select(F.col("features").alias("id"), "cluster")
    points = vertices.select("id", "features")
    found = lookup(points, total, "features", by_place, placed.rows, {"cluster": "cluster"}, limits)
    return found.select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def _dbscan_planar(
    scratch: Scratch,
    vertices: DataFrame,
    total: int,
    eps: float,
    min_points: int,
    metric: str,
    dim: int,
    limits: Limits,
) -> DataFrame:
    """``dbscan`` without the pairs within ``eps``, whose number grows with the square of the points."""
    cores, arcs = near_places(vertices, min_points, metric, limits, named=True)
    places = scratch.store(cores)
    core = scratch.store(places.df.where(F.col("core") <= eps).select("id", "features"))
    links = core.df.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    if core.rows:
        edges, _ = planar.planar_candidates(core.df, metric, dim, core.rows, longest=eps)
        links = edges.where(F.col("w") <= eps).select("src", "dst")
    comps = scratch.store(connected_components(links, core.df.select("id"), limits))
    placed = comps.df
    if arcs is not None:
        # a place that isn't core has fewer others within eps than it has arcs
        near = scratch.store(arcs.df.where(F.col("w") <= eps).join(core.df.select("id"), F.col("src") == F.col("id"), "left_anti"))
        border = (
            lookup(near.df.select("src", "dst"), near.rows, "dst", comps.df, comps.rows, {"comp": "comp"}, limits)
            .where("comp is not null")
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("comp").alias("comp"))
        )
        placed = placed.unionByName(border)
    by_place = scratch.store(
        places.df.select("id", F.col("features").alias("_at")).join(placed, "id").select(F.col("_at").alias("id"), F.col("comp").alias("cluster"))
    )
    points = vertices.select(
        "id", F.transform("features", lambda x: x.cast("double")).alias("_at")
    )
    found = lookup(points, total, "_at", by_place.df, by_place.rows, {"cluster": "cluster"}, limits)
    return found.select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
