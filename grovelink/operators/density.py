"""Density hierarchy: core distances, reachability forest, condensed tree of density levels.

Two points are reachable from each other at the largest of their distance and their two core
distances. The components of that graph at ``eps`` are the clusters of core points that
``dbscan`` finds at ``eps``, so its spanning forest holds those of every smaller radius. The
hierarchy reads the forest once: each level takes the links of its own band, between the clusters
of the level before. Clusters below a size are left out, and a cluster with one child is that
child grown, which leaves a tree of branches; labels take the branches with the largest mass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..scratch import Scratch, Stored
from . import planar
from .components import connected_components
from .cores import DBSCAN_MIN_POINTS, core_distances
from .forest import PLANAR_ROWS, minimum_spanning_forest
from .grid import GRID_METRICS
from .pairs import dimension, eps_join


@dataclass
class Reachability:
    """places(id, features, weight, core) of distinct points and the forest(src, dst, w) over them."""

    places: Stored
    forest: Stored


@dataclass
class DensityHierarchy:
    """clusters(level, eps, comp, n, mass, chosen) and labels(id, cluster)."""

    clusters: DataFrame
    labels: DataFrame


def reachability_forest(
    vertices: DataFrame,
    max_eps: float,
    min_points: int = DBSCAN_MIN_POINTS,
    metric: str = "euclidean",
    limits: Limits = DEFAULT_LIMITS,
    planar_rows: int = PLANAR_ROWS,
) -> Reachability:
    """Minimum spanning forest of the mutual reachability graph, as far as ``max_eps``.

    Of more than ``planar_rows`` core points in two or three dimensions only those meet that can be
    neighbours in it (``planar``), however many are within ``max_eps`` of each other.
    """
    scratch = Scratch(vertices.sparkSession, "reachability")
    places = scratch.store(core_distances(vertices, min_points, metric, limits))
    cores = places.df.where(F.col("core") <= max_eps)
    rows = cores.count()
    dim = dimension(cores) if metric in GRID_METRICS and rows > planar_rows else 0
    if dim in planar.CURVE_BITS:
        edges, _ = planar.planar_candidates(cores.where("id is not null"), metric, dim, rows, longest=max_eps)
        tree = minimum_spanning_forest(edges.where(F.col("w") <= max_eps), limits=limits, canonical=True)
        return Reachability(places, scratch.store(tree.edges))
    near = scratch.store(eps_join(cores.select("id", "features"), max_eps, metric))
    links = near.df
    for end in ("src", "dst"):
        links = lookup(links, near.rows, end, cores, places.rows, {"core": f"{end}_core"}, limits)
    links = links.select("src", "dst", F.greatest("w", "src_core", "dst_core").alias("w"))
    tree = minimum_spanning_forest(links, limits=limits, canonical=True)
    forest = scratch.store(tree.edges)
    scratch.drop(near)
    return Reachability(places, forest)


def _grown(levels: Stored | None, moves: Stored, limits: Limits) -> DataFrame | None:
    """Clusters of a level with the cluster that holds them at the next one."""
    if levels is None:
        return None
    told = lookup(levels.df, levels.rows, "comp", moves.df, moves.rows, {"comp": "_to"}, limits)
    return told.withColumn("parent", F.coalesce("_to", "comp")).drop("_to")


def density_hierarchy(
    vertices: DataFrame,
    levels: Sequence[float],
    min_points: int = DBSCAN_MIN_POINTS,
    min_size: int = DBSCAN_MIN_POINTS,
    metric: str = "euclidean",
    limits: Limits = DEFAULT_LIMITS,
    planar_rows: int = PLANAR_ROWS,
) -> DensityHierarchy:
    """Clusters of core points at each radius of ``levels``, and the best branches as labels.

    A cluster is named by its smallest id and reported with ``min_size`` points or more; ``n`` counts
    its core points, copies included. The mass of a branch is the number of its points summed over
    1 / eps, from where it appears to where it joins another; the radius beyond the last level
    counts as infinite. Of a branch and those inside it the side with more mass is ``chosen`` (equal:
    the branch), at the branch's loosest level. Points of a chosen cluster get its name,
    all others -1, as do points with an undefined or infinite coordinate.
    """
    radii = [float(e) for e in levels]
    if not radii or radii[0] <= 0 or any(a >= b for a, b in zip(radii, radii[1:])):
        raise ValueError("levels must be positive and ascending")
    spark = vertices.sparkSession
    scratch = Scratch(spark, "density")
    reach = reachability_forest(vertices, radii[-1], min_points, metric, limits, planar_rows)
    gaps = [1 / a - 1 / b for a, b in zip(radii, radii[1:])] + [1 / radii[-1]]
    members: list[Stored] = []
    found: list[Stored] = []
    grown: list[Stored] = []
    below = None
    for level, eps in enumerate(radii):
        new, band = F.col("core") <= eps, F.col("w") <= eps
        if below is not None:
            new, band = new & (F.col("core") > below), band & (F.col("w") > below)
        below = eps
        inside = reach.places.df.where(new).select("id", F.col("id").alias("comp"), F.col("weight").alias("n"))
        if members:
            inside = members[-1].df.unionByName(inside)
        before = scratch.store(inside)
        links = scratch.store(reach.forest.df.where(band).select("src", "dst"))
        ends = links.df
        for end in ("src", "dst"):
            ends = lookup(ends, links.rows, end, before.df, before.rows, {"comp": f"{end}_comp"}, limits)
        ends = ends.select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst"))
        moves = scratch.store(connected_components(ends, limits=limits))
        moved = lookup(before.df, before.rows, "comp", moves.df, moves.rows, {"comp": "_to"}, limits)
        members.append(scratch.store(moved.select("id", F.coalesce("_to", "comp").alias("comp"), "n")))
        sizes = members[-1].df.groupBy("comp").agg(F.sum("n").alias("n")).where(F.col("n") >= min_size)
        inner = _grown(found[-1] if found else None, moves, limits)
        if inner is None:
            state = sizes.select("comp", "n", F.lit(0).cast("long").alias("kids"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("sub"))
        else:
            grown.append(scratch.store(inner))
            kids = grown[-1].df.groupBy(F.col("parent").alias("comp")).agg(
                F.count(F.lit(1)).alias("kids"),
                F.max("mass").alias("mass"),
                F.max("sub").alias("sub"),
                F.sum(F.greatest("mass", "sub")).alias("best"),
            )
            one = F.col("kids") == 1
            state = sizes.join(kids, "comp", "left").select(
                "comp",
                "n",
                F.coalesce("kids", F.lit(0).cast("long")).alias("kids"),
                F.when(one, F.col("mass")).otherwise(0.0).alias("mass"),
                F.when(one, F.col("sub")).otherwise(F.coalesce("best", F.lit(0.0))).alias("sub"),
            )
        found.append(scratch.store(state.withColumn("mass", F.col("mass") + F.col("n") * F.lit(gaps[level]))))
        scratch.drop(before, links, moves)

    # from the loosest level inwards: what lies in a chosen branch isn't chosen again
    chosen: list[Stored] = []
    for level in range(len(radii) - 1, -1, -1):
        if not chosen:
            told = found[level].df.select("comp", "n", "mass", "sub", F.lit(True).alias("_top"), F.lit(False).alias("_in"))
        else:
            above = chosen[-1].df.select(F.col("comp").alias("id"), F.col("kids").alias("_kids"), F.col("taken").alias("_in"))
            told = lookup(
                grown[level].df, grown[level].rows, "parent", above, chosen[-1].rows, {"_kids": "_kids", "_in": "_in"}, limits
            ).withColumn("_top", F.col("_kids") > 1)
        mine = F.col("_top") & ~F.col("_in") & (F.col("mass") >= F.col("sub"))
        told = told.select("comp", "n", "mass", mine.alias("chosen"), (F.col("_in") | mine).alias("taken"))
        chosen.append(scratch.store(told.join(found[level].df.select("comp", "kids"), "comp")))
    chosen.reverse()

    clusters, placed = None, None
    for level, (eps, table, own) in enumerate(zip(radii, chosen, members)):
        rows = table.df.select(F.lit(level).alias("level"), F.lit(eps).alias("eps"), "comp", "n", "mass", "chosen")
        names = table.df.where("chosen").select(F.col("comp").alias("id"), F.col("comp").alias("cluster"))
        part = lookup(own.df, own.rows, "comp", names, table.rows, {"cluster": "cluster"}, limits)
        part = part.where("cluster is not null").select("id", "cluster")
        clusters = rows if clusters is None else clusters.unionByName(rows)
        placed = part if placed is None else placed.unionByName(part)
    # a place is in one chosen cluster at most; its copies go with it
    by_place = scratch.store(
        reach.places.df.select("id", F.col("features").alias("_at")).join(placed, "id").select(F.col("_at").alias("id"), "cluster")
    )
    points = vertices.select(
        F.col("id").cast("long").alias("id"), F.transform("features", lambda x: x.cast("double")).alias("_at")
    )
    total = vertices.count()
    told = lookup(points, total, "_at", by_place.df, by_place.rows, {"cluster": "cluster"}, limits)
    return DensityHierarchy(clusters, told.select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster")))
