"""Whole questions composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weights import bucket_bounds
from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..operators.agglomerate import RUN_BITS, Hierarchy, agglomerate, run_of, tag_run, untag
from ..operators.components import connected_components
from ..operators.features import make_vertices, select_features
from ..operators.forest import FOREST_EDGES, PLANAR_ROWS, bucket_forests, complete_forest, cut_heaviest
from ..operators.pairs import (
    all_pairs,
    complete_forest_candidates,
    eps_join,
    k_nearest_per_vertex,
    knn,
    limit_edges,
)
from ..operators.perturbed import max_perturbed_weight, perturbed_forests, perturbed_graph, perturbed_nearest
from ..operators.stats import graph_summary, run_differences
from ..schema import assign_ids, edges_to_arcs
from ..scratch import Scratch
from ..sources.readers import read_feature_table

NEAR_ROWS = 5_000  # more points are not perturbed in all pairs if nearer ones do


def build_graph(
    spark: SparkSession,
    path: str,
    feature_columns: list[str] | None = None,
    use_all: bool = True,
    max_samples: int | None = None,
    max_edges: int | None = None,
    distance_threshold: float | None = None,
    metric: str = "euclidean",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, summary) of a feature table on disk."""
    table = read_feature_table(spark, path, max_samples)
    names = select_features([c for c in table.columns if c != "id"], feature_columns, use_all)
    vertices = make_vertices(table, names)
    edges = limit_edges(point_graph(vertices, distance_threshold, metric, len(names)), max_edges)
    return vertices, edges, graph_summary(vertices, edges, names)


def point_graph(
    vertices: DataFrame, threshold: float | None, metric: str = "euclidean", dim: int | None = None
) -> DataFrame:
    """Complete graph, or the pairs within ``threshold`` found without visiting all pairs."""
    if threshold is None:
        return all_pairs(vertices, metric)
    return eps_join(vertices, threshold, metric, dim)


def cut_clusters(forest: DataFrame, vertices: DataFrame, k: int = 2) -> DataFrame:
    """components(id, comp): what is left connected without the k-1 heaviest forest edges."""
    return connected_components(cut_heaviest(forest, k), vertices)


def point_clusters(vertices: DataFrame, k: int = 2, metric: str = "euclidean") -> DataFrame:
    """Single-linkage clusters of points: complete forest, cut, components."""
    return cut_clusters(complete_forest(vertices, metric).edges, vertices, k)


def cluster_points(
    vertices: DataFrame,
    k: int | None = None,
    num_clusters: int = 3,
    buckets: bool = False,
    gamma: float = 0.0,
    beta: float | None = None,
    alpha: float = 0.0,
    seed: int | str = 0,
    limits: Limits = DEFAULT_LIMITS,
    planar_rows: int = PLANAR_ROWS,
    near_rows: int = NEAR_ROWS,
) -> Hierarchy:
    """Points -> arcs -> linkage rounds.

    Plain: arcs to the ``k`` nearest; with ``k`` None or n-1 the graph is
    complete. In a symmetric graph every best-neighbour choice is an edge of
    the minimum spanning forest, so the complete graph is replaced by a
    sparsified graph that contains that forest: same labels and merges; for more than
    ``planar_rows`` points by the forest itself.
    With ``buckets``: all pairs, weights perturbed by ``gamma`` (and put into
    geometric buckets when ``beta`` is given), then the k lightest arcs with
    equal weights in random order. The perturbed pairs are made and cut down inside tasks; of more than
    ``near_rows`` points in up to three dimensions only those that can be among the k lightest.
    """
    n = vertices.count()
    whole = k is None or k >= n - 1
    if not buckets:
        if not whole:
            arcs = knn(vertices, k)
        elif n > planar_rows:
            # the forest alone does; in few dimensions it is found without all pairs
            arcs = edges_to_arcs(complete_forest(vertices, limits=limits, planar_rows=planar_rows, line_rows=planar_rows).edges)
        else:
            arcs = edges_to_arcs(complete_forest_candidates(vertices, rows=n))
        return agglomerate(arcs, vertices, num_clusters, limits=limits)
    bounds = None
    if beta is not None:
        bounds = bucket_bounds(max_perturbed_weight(vertices, gamma, seed), beta, alpha, seed)
    graph = None
    if not whole and n > near_rows:
        graph = perturbed_nearest(vertices, gamma, seed, k, bounds, tie_seed=seed)
    if graph is None:
        graph = perturbed_graph(vertices, gamma, [seed], None if whole else k, bounds, tie_seed=seed)
    arcs = graph.select("src", "dst", "w")
    arcs = edges_to_arcs(arcs) if whole else k_nearest_per_vertex(arcs, k, tie_seed=seed)
    return agglomerate(arcs, vertices, num_clusters, limits=limits)


def stability_runs(
    vertices: DataFrame,
    runs: int = 10,
    k: int | None = None,
    num_clusters: int = 3,
    gamma: float = 0.05,
    limits: Limits = DEFAULT_LIMITS,
    near_rows: int = PLANAR_ROWS,
) -> DataFrame:
    """runs(run, id, val): the parent of every vertex in each perturbed run.

    All runs go through the same rounds as one disjoint graph. A task perturbs the pairs of two
    blocks for every run and keeps their forest, which cannot drop an edge that any
    best-neighbour choice uses, or the k lightest arcs. Of more than ``near_rows`` points in complete
    graphs only pairs are drawn that can be in such a forest. Ids that leave no room for the run
    number are numbered in their own order meanwhile, so all ties fall alike.
    """
    spark = vertices.sparkSession
    scratch = Scratch(spark, "stability")
    n, lowest, highest = vertices.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    whole = k is None or k >= n - 1
    longest = None
    if whole and n > near_rows and 0.0 <= gamma < 1.0:
        # pairs that are much longer than any edge of the plain forest are in no perturbed one
        tree = complete_forest(vertices, limits=limits, planar_rows=near_rows, line_rows=near_rows).edges
        tree = scratch.store(tree).df
        longest = tree.agg(F.max("w")).first()[0]
    if longest:
        drawn = perturbed_forests(vertices, gamma, list(range(runs)), longest, tree=tree, limits=limits)
    else:
        drawn = perturbed_graph(vertices, gamma, list(range(runs)), None if whole else k)
    graph = scratch.store(drawn.withColumns({"_a": F.col("src"), "_b": F.col("dst")}))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("_run")
    ids, placed = vertices.select("id"), graph.df
    places = None
    if n and (lowest < 0 or highest >> RUN_BITS):
        places = scratch.store(assign_ids(ids.withColumnRenamed("id", "own"), "own", id_col="place"))
        by_own = places.df.select(F.col("own").alias("id"), "place")
        ids, placed = by_own.select(F.col("place").alias("id")), graph.df.drop("_a", "_b")
        for end, place in (("src", "_a"), ("dst", "_b")):
            placed = lookup(placed, graph.rows, end, by_own, places.rows, {"place": place}, limits)
    tagged = placed.select(
        tag_run(F.col("_a"), F.col("run")).alias("src"), tag_run(F.col("_b"), F.col("run")).alias("dst"), "w"
    )
    if longest and n <= FOREST_EDGES:
        # the forests of the tasks are many edges more than one of each run
        tagged = bucket_forests(tagged, run_of(F.col("src")), runs)
    arcs = edges_to_arcs(tagged) if whole else k_nearest_per_vertex(tagged, k)
    everyone = ids.select("id", numbers).select(
        tag_run(F.col("id"), F.col("_run")).alias("id")
    )
    done = agglomerate(arcs, everyone, num_clusters, runs=runs, limits=limits)
    found = done.merges.select(
        run_of(F.col("id")).alias("run"),
        untag(F.col("id")).alias("id"),
        untag(F.col("parent")).alias("val"),
    )
    if places is None:
        return found
    by_place = places.df.select(F.col("place").alias("id"), "own")
    back = found.toDF("run", "_vertex", "_parent")
    for own, name in (("_vertex", "id"), ("_parent", "val")):
        back = lookup(back, n * runs, own, by_place, places.rows, {"own": name}, limits)
    return back.select("run", "id", "val")


def stability_study(vertices: DataFrame, runs: int = 10, **options) -> DataFrame:
    """(run_a, run_b, diff): how many vertices have another parent in another run."""
    return run_differences(stability_runs(vertices, runs, **options), list(range(runs)))
