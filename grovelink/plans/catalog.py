"""Named queries over the shared test tables, one per operator or composition.

Every query reads whole tables. Outputs round doubles to six digits, because
different engines add doubles in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import schema, sources
from ..functions.scalars import bucket_count, density_exponent, edge_budget, partition_count
from ..lookup import SHUFFLE_ONLY, Limits
from ..operators import agglomerate as agg
from ..operators import (
    compare,
    components,
    contraction,
    density,
    features,
    forest,
    linkage,
    minibatch,
    modify,
    pairs,
    spectral,
    stats,
)
from ..scratch import Scratch
from . import graphs

Query = Callable[[SparkSession, str], DataFrame]

SUPPLIER_OFFSET = 1_000_000_000
THRESHOLD = 1.2
EPS = 60.0
DENSITY_LEVELS = (60.0, 120.0, 240.0)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def suppliers_1d(spark, sf):
    return _table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.array("s_acctbal").alias("features")
    )


def suppliers_2d(spark, sf):
    y = (F.col("s_nationkey") * 400).cast("double")
    return _table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.array("s_acctbal", y).alias("features")
    )


def customers_1d(spark, sf):
    return _table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.array("c_acctbal").alias("features")
    )


def customers_2d(spark, sf):
    y = (F.col("c_nationkey") * 400).cast("double")
    return _table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.array("c_acctbal", y).alias("features")
    )


def embeddings(spark, sf):
    return _table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").cast("double").alias("label"),
    )


def part_supplier_rows(spark, sf):
    """Every line item as an edge part - supplier, stored in either orientation."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey") + SUPPLIER_OFFSET
    odd = F.col("l_linenumber") % 2 == 1
    return _table(spark, sf, "lineitem").select(
        F.when(odd, part).otherwise(supp).alias("src"),
        F.when(odd, supp).otherwise(part).alias("dst"),
        F.col("l_extendedprice").alias("w"),
    )


def part_supplier(spark, sf):
    return schema.canonical_edges(part_supplier_rows(spark, sf))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols or ("w",):
        df = df.withColumn(c, F.round(c, 6))
    return df


def _xy(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        F.round(F.col("features")[0], 6).alias("x"),
        F.round(F.col("features")[1], 6).alias("y"),
    )


def _folder(spark, name: str) -> str:
    return Scratch(spark, name).folder


# --- sources and sinks ---------------------------------------------------------------


def q_read_polygon_json(spark, sf):
    """Graphs of up to 50 suppliers each: a chain with its first edge repeated."""
    point = F.struct("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 400).cast("double").alias("y"))
    several = F.size("p") > 1

    def chain(start, less):
        ends = F.concat(F.sequence(F.lit(start), F.size("p") - less), F.array(F.lit(start)))
        return F.when(several, ends).otherwise(F.array().cast("array<int>"))

    docs = (
        _table(spark, sf, "supplier")
        .groupBy(F.floor(F.col("s_suppkey") / 50).alias("g"))
        .agg(F.array_sort(F.collect_list(point)).alias("p"))
        .select(
            "g",
            F.size("p").alias("n"),
            F.when(several, F.size("p")).otherwise(0).alias("m"),
            F.col("p.s_acctbal").alias("x"),
            F.col("p.y").alias("y"),
            chain(0, 2).alias("edge_i"),
            chain(1, 1).alias("edge_j"),
        )
    )
    path = _folder(spark, "polygon")
    docs.write.partitionBy("g").option("maxRecordsPerFile", 1).json(path)
    _, arcs = sources.read_polygon_json(spark, path)
    return arcs.select(
        F.regexp_extract("graph", "g=([0-9]+)", 1).cast("long").alias("graph"),
        "src",
        "dst",
        F.round("w", 6).alias("w"),
    )


def q_read_edge_tsv(spark, sf):
    path = _folder(spark, "tsv")
    part_supplier_rows(spark, sf).write.csv(path, sep="\t")
    return _rounded(sources.read_edge_tsv(spark, path, weighted=True))


def q_read_edge_tsv_drawn(spark, sf):
    path = _folder(spark, "tsv")
    part_supplier_rows(spark, sf).select("src", "dst").write.csv(path, sep="\t")
    return sources.read_edge_tsv(spark, path, distribution="zipf", seed=5)


def q_read_edge_csv(spark, sf):
    path = _folder(spark, "csv")
    part_supplier_rows(spark, sf).select(
        F.concat(F.lit("v"), "src"), F.concat(F.lit("v"), "dst"), "w"
    ).write.csv(path)
    edges, names = sources.read_edge_csv(spark, path)
    a = names.select(F.col("id").alias("src"), F.col("name").alias("a"))
    b = names.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return _rounded(edges.join(a, "src").join(b, "dst"))


def q_read_points_csv(spark, sf):
    """Points written as CSV and read back."""
    path = _folder(spark, "points")
    sources.write_points_csv(suppliers_2d(spark, sf).orderBy("id"), path)
    points = _xy(sources.read_points_csv(spark, path))
    return points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def q_read_csv_columns(spark, sf):
    path = _folder(spark, "columns")
    _table(spark, sf, "part").write.csv(path, header=True)
    points = _xy(sources.read_csv_columns(spark, path, ["p_retailprice", "p_size"]))
    return points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def q_build_graph(spark, sf):
    """Feature CSV -> vertices -> edges under a threshold -> summary row."""
    path = _folder(spark, "features")
    _table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("signal"),
        F.col("c_acctbal").alias("f1"),
        (F.col("c_nationkey") * 400).alias("f2"),
        F.col("c_custkey").alias("other"),
    ).write.csv(path, header=True)
    _, _, summary = graphs.build_graph(spark, path, use_all=False, distance_threshold=EPS)
    return _summary_row(summary)


def _summary_row(summary: DataFrame) -> DataFrame:
    weights = [f"{s}_edge_weight" for s in ("min", "max", "mean", "median")]
    return summary.select(
        "num_vertices",
        "num_edges",
        F.col("num_features").cast("int").alias("num_features"),
        F.concat_ws(",", "feature_names").alias("feature_names"),
        *[F.round(c, 6).alias(c) for c in weights],
    )


def q_export_edge_map(spark, sf):
    """Edge map with small parts, so that big vertices do span several rows; read back."""
    edge_map = sources.export_edge_map(part_supplier_rows(spark, sf), max_entries=8)
    return _rounded(sources.explode_edge_map(edge_map))


def q_first_rows(spark, sf):
    return sources.first_rows(_table(spark, sf, "customer"), ["c_custkey"], 100).select(
        "c_custkey", "c_acctbal"
    )


def q_assign_ids(spark, sf):
    return schema.assign_ids(
        _table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey"
    ).select("id", "c_custkey")


# --- projections, filters, joins -------------------------------------------------------


def q_make_vertices(spark, sf):
    part = _table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").alias("signal"), F.col("p_retailprice").alias("f1"),
        (F.col("p_size") * 2).alias("f2"), F.col("p_retailprice").alias("other"),
    )
    names = features.select_features(part.columns, use_all=False)
    v = features.make_vertices(part, names, id_col="p_partkey")
    return v.select("id", F.col("features")[0].alias("f1"), F.col("features")[1].alias("f2"), "label")


def q_edge_dedup(spark, sf):
    return _rounded(part_supplier(spark, sf))


def q_edges_to_arcs(spark, sf):
    return _rounded(schema.edges_to_arcs(part_supplier(spark, sf)))


def q_adjacency(spark, sf):
    """Neighbour lists built and flattened again."""
    nested = schema.nested_adjacency(schema.edges_to_arcs(part_supplier(spark, sf)), 50)
    return _rounded(schema.explode_adjacency(nested))


def q_distinct_vertices(spark, sf):
    return schema.distinct_vertices(part_supplier_rows(spark, sf))


def _all_pairs(metric: str) -> Query:
    return lambda spark, sf: _rounded(pairs.all_pairs(embeddings(spark, sf), metric))


def q_threshold_edges(spark, sf):
    return _rounded(pairs.all_pairs(embeddings(spark, sf), threshold=THRESHOLD))


def q_max_edges(spark, sf):
    near = pairs.all_pairs(embeddings(spark, sf), threshold=1.3, first=1000)
    return _rounded(pairs.limit_edges(near, 1000))


def q_eps_join_1d(spark, sf):
    return _rounded(pairs.eps_join(customers_1d(spark, sf), 0.75))


def q_eps_join_2d(spark, sf):
    return _rounded(pairs.eps_join(customers_2d(spark, sf), EPS))


def q_eps_join_salted(spark, sf):
    """The same join with tiny cell parts, so that every crowded cell is salted."""
    return _rounded(pairs.eps_join(customers_2d(spark, sf), EPS, cell_rows=2))


def q_knn_pivots(spark, sf):
    return _rounded(pairs.knn(embeddings(spark, sf), 5, pivot_rows=0))


def q_eps_join_pivots(spark, sf):
    return _rounded(pairs.eps_join(embeddings(spark, sf), THRESHOLD, pivot_rows=0))


def q_knn_join(spark, sf):
    return _rounded(pairs.knn(embeddings(spark, sf), 5))


def q_knn_grid(spark, sf):
    """Nearest customers by growing grid cells, whatever the table size."""
    return _rounded(pairs.knn(customers_2d(spark, sf), 5, grid_rows=0))


def q_knn_cosine(spark, sf):
    return _rounded(pairs.knn(embeddings(spark, sf), 3, "cosine"))


def q_knn_symmetric(spark, sf):
    return pairs.knn_symmetric(embeddings(spark, sf), 3)


def q_k_nearest_shuffled(spark, sf):
    """Three lightest arcs per vertex after bucketing, ties in seeded random order."""
    edges = part_supplier(spark, sf)
    bounds = fn.bucket_bounds(fn.max_weight(edges), 0.2, 0.1, seed=3)
    arcs = fn.bucketize(schema.edges_to_arcs(edges), bounds)
    return pairs.k_nearest_per_vertex(arcs, 3, tie_seed=11)


def q_edges_between(spark, sf):
    edges = part_supplier(spark, sf)
    ids = schema.distinct_vertices(edges)
    u = ids.where(F.col("id") % 3 == 0)
    v = ids.where(F.col("id") % 3 == 1)
    return _rounded(forest.edges_between(edges, u, v))


def q_remove_edges(spark, sf):
    edges = part_supplier(spark, sf)
    return _rounded(forest.remove_edges(edges, edges.where(F.col("w") > 30000.0)))


def q_forest_in_cluster(spark, sf):
    comps = components.connected_components(
        pairs.eps_join(suppliers_1d(spark, sf), 100.0), suppliers_1d(spark, sf)
    )
    tree = forest.complete_forest(suppliers_1d(spark, sf)).edges
    cluster = comps.where(F.col("comp") == 0)
    return _rounded(forest.forest_in_cluster(tree, cluster))


def q_attach_label(spark, sf):
    return stats.attach_label(_embedding_components(spark, sf), embeddings(spark, sf)).select(
        "id", "comp", "label"
    )


# --- linkage round ---------------------------------------------------------------------


def q_best_neighbour(spark, sf):
    edges = part_supplier(spark, sf)
    return _rounded(contraction.best_neighbours(schema.edges_to_arcs(edges)))


def q_leaders_path_min(spark, sf):
    best = contraction.best_neighbours(schema.edges_to_arcs(part_supplier(spark, sf)))
    return contraction.find_leaders(best)


def q_leaders_component_min(spark, sf):
    best = contraction.best_neighbours(schema.edges_to_arcs(part_supplier(spark, sf)))
    return contraction.find_leaders(best, "component_min")


def q_relabel(spark, sf):
    arcs = schema.edges_to_arcs(part_supplier(spark, sf))
    leaders = contraction.find_leaders(contraction.best_neighbours(arcs))
    return (
        contraction.drop_internal(contraction.relabel(arcs, leaders))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.min("w"), 6).alias("w"))
    )


def q_contract_once(spark, sf):
    arcs = schema.edges_to_arcs(part_supplier(spark, sf))
    leaders = contraction.find_leaders(contraction.best_neighbours(arcs))
    return _rounded(contraction.contract(arcs, leaders))


# --- aggregates ------------------------------------------------------------------------


def q_graph_summary(spark, sf):
    v = embeddings(spark, sf)
    edges = pairs.all_pairs(v, threshold=THRESHOLD)
    return _summary_row(stats.graph_summary(v, edges, ["embedding"]))


def q_edge_count(spark, sf):
    arcs = schema.edges_to_arcs(part_supplier(spark, sf))
    return stats.edge_count(arcs, symmetric=True)


def q_max_weight(spark, sf):
    return part_supplier(spark, sf).agg(F.max("w").alias("w"))


def q_bounding_box(spark, sf):
    return stats.bounding_box(customers_2d(spark, sf))


def q_exact_median(spark, sf):
    return stats.exact_median(part_supplier(spark, sf), "w", "src", "dst")


def q_bucket_histogram(spark, sf):
    edges = part_supplier(spark, sf)
    bounds = fn.bucket_bounds(fn.max_weight(edges), 0.2, 0.1, seed=3)
    return _rounded(fn.bucket_histogram(edges, bounds), "lo", "hi")


def q_run_differences(spark, sf):
    """Two label tables of the same line items plus a third with changed values."""
    rows = _table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_suppkey").alias("a"), F.min("l_suppkey").alias("b"), F.max("l_partkey").alias("c")
    )
    cells = F.array(*[
        F.struct(F.lit(i).alias("run"), F.col(c).alias("val")) for i, c in enumerate("abc")
    ])
    runs = rows.select(F.col("l_orderkey").alias("id"), F.explode(cells).alias("_r"))
    return stats.run_differences(runs.select("_r.run", "id", "_r.val"), [0, 1, 2])


def q_removed_edges(spark, sf):
    flagged = forest.bucket_msf(part_supplier(spark, sf), F.col("dst") % 4, 4)
    return _rounded(forest.removed_edges(flagged))


def q_label_crosstab(spark, sf):
    return stats.label_crosstab(_embedding_components(spark, sf), embeddings(spark, sf))


def q_cluster_sizes(spark, sf):
    return stats.cluster_sizes(_embedding_components(spark, sf))


def q_bucket_msf(spark, sf):
    edges = part_supplier(spark, sf)
    done = forest.bucket_msf(edges, F.col("dst") % 4, 4)
    return _rounded(done.select("src", "dst", "w", F.col("kept").cast("int").alias("kept")))


# --- sorts, sampling -------------------------------------------------------------------


def q_heaviest_edges(spark, sf):
    return _rounded(forest.heaviest_edges(part_supplier(spark, sf), 25))


def q_edges_sorted(spark, sf):
    ordered = schema.assign_ids(part_supplier(spark, sf), "w", "src", "dst", id_col="pos")
    return _rounded(ordered)


def q_random_partition(spark, sf):
    return modify.random_partition(customers_2d(spark, sf), 7, seed=3)


# --- functions -------------------------------------------------------------------------


def q_column_distances(spark, sf):
    """Distance columns between each vector and the next one."""
    v = embeddings(spark, sf).select("id", "features")
    after = v.select((F.col("id") - 1).alias("id"), F.col("features").alias("next"))
    x, y = F.col("features"), F.col("next")
    return v.join(after, "id").select(
        "id", *[F.round(fn.distance(x, y, m), 6).alias(m) for m in ("euclidean", "manhattan", "cosine")]
    )


def q_perturb_weights(spark, sf):
    arcs = fn.perturb_weights(schema.edges_to_arcs(part_supplier(spark, sf)), 0.05, 42)
    return arcs.withColumn("w", F.round("w", 3))


def q_bucket_weights(spark, sf):
    edges = part_supplier(spark, sf)
    return fn.bucketize(edges, fn.bucket_bounds(fn.max_weight(edges), 0.2, 0.1, seed=3))


def _random_weight(distribution: str) -> Query:
    def query(spark, sf):
        edges = part_supplier(spark, sf)
        return _rounded(edges.withColumn("w", fn.random_weight(distribution, seed=5)))

    return query


def q_size_parameters(spark, sf):
    """The sparsifier's size parameters of the part - supplier graph."""
    edges = part_supplier(spark, sf)
    n, m = schema.distinct_vertices(edges).count(), edges.count()
    c = density_exponent(n, m)
    row = (
        n, m, round(c, 6), round(edge_budget(n, 0.125), 6),
        bucket_count(n, m, 0.125), partition_count(n, c, 0.125),
    )
    return spark.createDataFrame(
        [row], "n long, m long, c double, budget double, buckets long, parts long"
    )


def q_standardize(spark, sf):
    part = _table(spark, sf, "part")
    v = features.make_vertices(part, ["p_size", "p_retailprice"], "p_partkey", label=None)
    return _xy(features.standardize(v))


def q_first_two(spark, sf):
    return _xy(features.first_two(embeddings(spark, sf)))


def q_pca_project(spark, sf):
    return _xy(features.pca_project(embeddings(spark, sf))[0])


# --- iterative -------------------------------------------------------------------------


def _weights_of(tree: DataFrame) -> DataFrame:
    return _rounded(tree).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def q_mst_1d(spark, sf):
    """Weights of the spanning tree of the complete graph over account balances."""
    return _weights_of(forest.complete_forest(customers_1d(spark, sf)).edges)


def q_mst_line(spark, sf):
    """The same weights by the sorted form that large tables on a line take."""
    return _weights_of(forest.complete_forest(customers_1d(spark, sf), line_rows=0).edges)


def q_mst_cut_1d(spark, sf):
    return stats.cluster_sizes(graphs.point_clusters(suppliers_1d(spark, sf), 3))


def q_mst_2d(spark, sf):
    return _rounded(forest.complete_forest(suppliers_2d(spark, sf)).edges)


def q_mst_planar(spark, sf):
    # the form for large tables; small blocks, so that there are several here
    points = customers_2d(spark, sf)
    return _rounded(forest.complete_forest(points, planar_rows=0, line_rows=0, block_rows=64).edges)


def q_mst_embeddings(spark, sf):
    return _rounded(forest.complete_forest(embeddings(spark, sf)).edges)


def q_mst_manhattan(spark, sf):
    return _rounded(forest.complete_forest(suppliers_2d(spark, sf), "manhattan").edges)


def _edge_forest(**options) -> Query:
    def query(spark, sf):
        edges = part_supplier(spark, sf)
        return _rounded(forest.minimum_spanning_forest(edges, canonical=True, **options).edges)

    return query


def _embedding_components(spark, sf):
    v = embeddings(spark, sf)
    return components.connected_components(pairs.all_pairs(v, threshold=1.1), v.select("id"))


def q_connected_components(spark, sf):
    return _embedding_components(spark, sf)


def q_components_customers(spark, sf):
    v = customers_2d(spark, sf)
    return components.connected_components(pairs.eps_join(v, EPS), v.select("id"))


def q_components_shuffled(spark, sf):
    v = customers_2d(spark, sf)
    return components.connected_components(pairs.eps_join(v, EPS), v.select("id"), SHUFFLE_ONLY)


def q_agglomerate_shuffled(spark, sf):
    return graphs.cluster_points(suppliers_2d(spark, sf), limits=SHUFFLE_ONLY).labels()


def q_forest_segments(spark, sf):
    v = suppliers_2d(spark, sf)
    tree = Scratch(spark, "tree").store(forest.complete_forest(v).edges).df
    rest = forest.cut_heaviest(tree, 3)
    comps = components.connected_components(rest, v.select("id"))
    return _rounded(
        stats.forest_segments(rest, v, comps), "w", "src_x", "src_y", "dst_x", "dst_y"
    )


def q_agglomerate_labels(spark, sf):
    return graphs.cluster_points(suppliers_2d(spark, sf)).labels()


def q_agglomerate_merges(spark, sf):
    return graphs.cluster_points(embeddings(spark, sf), k=5).merges


def q_agglomerate_components(spark, sf):
    """The textbook leader: smallest id of the whole group."""
    v = suppliers_2d(spark, sf)
    arcs = pairs.knn(v, 4)
    return agg.agglomerate(arcs, v, leader="component_min").labels()


def q_agglomerate_graph(spark, sf):
    """Arcs left between the clusters when there are no more than 40 of them."""
    v = embeddings(spark, sf)
    return _rounded(agg.agglomerate(pairs.knn(v, 5), v, num_clusters=40).graph)


def q_cluster_perturbed(spark, sf):
    """Perturbed and bucketed weights, nearest arcs with shuffled ties, linkage rounds."""
    v = suppliers_2d(spark, sf)
    done = graphs.cluster_points(v, k=8, buckets=True, gamma=0.05, beta=0.2, alpha=0.1, seed=9)
    return done.final_labels()


def q_stability_study(spark, sf):
    return graphs.stability_study(suppliers_2d(spark, sf), runs=10)


def q_cluster_segments(spark, sf):
    v = suppliers_2d(spark, sf)
    done = graphs.cluster_points(v)
    rows = stats.cluster_segments(done.merges, v, done.final_labels())
    return _rounded(rows, "x", "y", "parent_x", "parent_y")


# --- data modification -------------------------------------------------------------------


def q_noise_uniform(spark, sf):
    return _xy(modify.add_uniform_noise(customers_2d(spark, sf), 0.1, seed=4))


def _shape(shape: str) -> Query:
    return lambda spark, sf: _xy(modify.add_shape_noise(customers_2d(spark, sf), shape, 0.1))


def q_delete_vertices(spark, sf):
    edges = part_supplier(spark, sf)
    ids = schema.distinct_vertices(edges)
    _, left = modify.delete_random_vertices(ids, schema.edges_to_arcs(edges), 0.05, seed=6)
    return _rounded(left)


def q_delete_edges(spark, sf):
    arcs = schema.edges_to_arcs(part_supplier(spark, sf))
    return _rounded(modify.delete_random_edges(arcs, 0.05, seed=6))


# --- comparison clusterers ---------------------------------------------------------------


def q_dbscan(spark, sf):
    return compare.dbscan(customers_2d(spark, sf), EPS, 3)


def _density(spark, sf):
    return density.density_hierarchy(customers_2d(spark, sf), DENSITY_LEVELS, 3, 5)


def q_density_levels(spark, sf):
    """Clusters of core points at three radii, and which of them the labels take."""
    return _density(spark, sf).clusters.select("level", "comp", "n", "chosen")


def q_density_clusters(spark, sf):
    return _density(spark, sf).labels


def q_minibatch_kmeans(spark, sf):
    return minibatch.minibatch_kmeans(customers_2d(spark, sf), 3, batch=300, steps=5, seed=3)


def q_spectral_lanczos(spark, sf):
    """k-means on the vectors of the three smallest eigenvalues of the neighbour graph's Laplacian."""
    v = embeddings(spark, sf)
    graph = pairs.knn_symmetric(v, 10)
    return compare.kmeans(spectral.spectral_embedding(graph, v, 3).vectors, 3)


def _linkage(method: str) -> Query:
    def query(spark, sf):
        v = suppliers_2d(spark, sf)
        merges = linkage.connected_linkage(pairs.knn(v, 5), v, method)
        return merges.select("round", "src", "dst", F.round("w", 4).alias("w"), "n")

    return query


QUERIES: dict[str, Query] = {
    "read_polygon_json": q_read_polygon_json,
    "read_edge_tsv": q_read_edge_tsv,
    "read_edge_tsv_drawn": q_read_edge_tsv_drawn,
    "read_edge_csv": q_read_edge_csv,
    "read_points_csv": q_read_points_csv,
    "read_csv_columns": q_read_csv_columns,
    "build_graph": q_build_graph,
    "export_edge_map": q_export_edge_map,
    "first_rows": q_first_rows,
    "assign_ids": q_assign_ids,
    "make_vertices": q_make_vertices,
    "edge_dedup": q_edge_dedup,
    "edges_to_arcs": q_edges_to_arcs,
    "adjacency": q_adjacency,
    "distinct_vertices": q_distinct_vertices,
    "all_pairs_euclidean": _all_pairs("euclidean"),
    "all_pairs_manhattan": _all_pairs("manhattan"),
    "all_pairs_cosine": _all_pairs("cosine"),
    "threshold_edges": q_threshold_edges,
    "max_edges": q_max_edges,
    "eps_join_1d": q_eps_join_1d,
    "eps_join_2d": q_eps_join_2d,
    "eps_join_salted": q_eps_join_salted,
    "knn_join": q_knn_join,
    "knn_pivots": q_knn_pivots,
    "eps_join_pivots": q_eps_join_pivots,
    "knn_grid": q_knn_grid,
    "knn_cosine": q_knn_cosine,
    "knn_symmetric": q_knn_symmetric,
    "k_nearest_shuffled": q_k_nearest_shuffled,
    "edges_between": q_edges_between,
    "remove_edges": q_remove_edges,
    "forest_in_cluster": q_forest_in_cluster,
    "attach_label": q_attach_label,
    "best_neighbour": q_best_neighbour,
    "leaders_path_min": q_leaders_path_min,
    "leaders_component_min": q_leaders_component_min,
    "relabel": q_relabel,
    "contract_once": q_contract_once,
    "graph_summary": q_graph_summary,
    "edge_count": q_edge_count,
    "max_weight": q_max_weight,
    "bounding_box": q_bounding_box,
    "exact_median": q_exact_median,
    "bucket_histogram": q_bucket_histogram,
    "run_differences": q_run_differences,
    "label_crosstab": q_label_crosstab,
    "cluster_sizes": q_cluster_sizes,
    "bucket_msf": q_bucket_msf,
    "removed_edges": q_removed_edges,
    "heaviest_edges": q_heaviest_edges,
    "edges_sorted": q_edges_sorted,
    "random_partition": q_random_partition,
    "column_distances": q_column_distances,
    "perturb_weights": q_perturb_weights,
    "bucket_weights": q_bucket_weights,
    "random_weight_gaussian": _random_weight("gaussian"),
    "random_weight_zipf": _random_weight("zipf"),
    "random_weight_uniform": _random_weight("uniform"),
    "size_parameters": q_size_parameters,
    "standardize": q_standardize,
    "first_two": q_first_two,
    "pca_project": q_pca_project,
    "mst_1d": q_mst_1d,
    "mst_line": q_mst_line,
    "mst_cut_1d": q_mst_cut_1d,
    "mst_2d": q_mst_2d,
    "mst_manhattan": q_mst_manhattan,
    "mst_planar": q_mst_planar,
    "mst_embeddings": q_mst_embeddings,
    "mst_sparsified": _edge_forest(sparsifier="hash"),
    "mst_vertex_partition": _edge_forest(sparsifier="vertex"),
    "mst_two_way": _edge_forest(sparsifier="two_way"),
    "mst_contraction": _edge_forest(sparsifier=None, limits=Limits(finish_edges=0)),
    "mst_shuffled": _edge_forest(limits=SHUFFLE_ONLY),
    "connected_components": q_connected_components,
    "components_customers": q_components_customers,
    "components_shuffled": q_components_shuffled,
    "forest_segments": q_forest_segments,
    "agglomerate_labels": q_agglomerate_labels,
    "agglomerate_shuffled": q_agglomerate_shuffled,
    "agglomerate_merges": q_agglomerate_merges,
    "agglomerate_components": q_agglomerate_components,
    "agglomerate_graph": q_agglomerate_graph,
    "cluster_perturbed": q_cluster_perturbed,
    "stability_study": q_stability_study,
    "cluster_segments": q_cluster_segments,
    "noise_uniform": q_noise_uniform,
    "noise_circle": _shape("circle"),
    "noise_hline": _shape("horizontal_line"),
    "noise_vline": _shape("vertical_line"),
    "delete_vertices": q_delete_vertices,
    "delete_edges": q_delete_edges,
    "kmeans": lambda spark, sf: compare.kmeans(embeddings(spark, sf), 10),
    "gaussian_mixture": lambda spark, sf: compare.gaussian_mixture(customers_2d(spark, sf), 3),
    "spectral": lambda spark, sf: compare.spectral(embeddings(spark, sf), 3),
    "dbscan": q_dbscan,
    "density_levels": q_density_levels,
    "density_clusters": q_density_clusters,
    "minibatch_kmeans": q_minibatch_kmeans,
    "spectral_lanczos": q_spectral_lanczos,
    "linkage_ward": _linkage("ward"),
    "linkage_average": _linkage("average"),
}
