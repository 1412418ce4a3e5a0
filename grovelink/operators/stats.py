"""Summaries of graphs, clusters and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..schema import assign_ids
from ..scratch import Scratch

COLOURS = 23  # fixed value: number of colours a cluster index is reduced to
MEDIAN_MARGIN = 0.001  # share of the weights to either side of the median that a second pass looks at
MEDIAN_ACCURACY = 10_000


def exact_median(df: DataFrame, value: str, *ties: str, rows: int | None = None) -> DataFrame:
    """One row (median): mean of the middle one or two values of a distributed sort."""
    n = df.count() if rows is None else rows
    if n == 0:
        return df.agg(F.lit(None).cast("double").alias("median"))
    ordered = assign_ids(df.select(value, *ties), value, *ties, id_col="_pos")
    middle = ordered.where(F.col("_pos").isin((n - 1) // 2, n // 2))
    return middle.agg(F.avg(value).alias("median"))


def _median_of_counts(counts: DataFrame, places: list[int]) -> DataFrame:
    """One row (median): mean of the weights at two places, from 0, of counts(w, n) in order."""
    ordered = counts.orderBy("w").withColumn("_part", F.spark_partition_id())
    kept = Scratch(counts.sparkSession, "median").store(ordered)
    sums = {r["_part"]: r["s"] for r in kept.df.groupBy("_part").agg(F.sum("n").alias("s")).collect()}
    found, before = [], 0
    for part in sorted(sums):
        wanted = [p - before for p in places if before <= p < before + sums[part]]
        if wanted:
            upto = F.sum("n").over(Window.partitionBy("_part").orderBy("w"))
            mine = kept.df.where(F.col("_part") == part).withColumn("_upto", upto)
            for p in wanted:
                found.append(mine.where(F.col("_upto") > p).agg(F.min("w").alias("w")))
        before += sums[part]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return both.agg(F.avg("w").alias("median"))


def graph_summary(vertices: DataFrame, edges: DataFrame, feature_names: list[str]) -> DataFrame:
    """One row: counts, features and min / max / mean / median weight (NULL without edges).

    No edges are stored: one pass takes the counts and two weights that enclose the median closely,
    a second one keeps the weights between them, from which the median is exact.
    """
    w = F.col("w")
    near = F.percentile_approx(w, [0.5 - MEDIAN_MARGIN, 0.5 + MEDIAN_MARGIN], MEDIAN_ACCURACY)
    told = edges.agg(
        F.count(F.lit(1)).alias("n"), F.count(w).alias("known"), F.min(w).alias("low"), F.max(w).alias("high"), F.avg(w).alias("mean"), near.alias("near")
    ).first()
    median = None
    if told["n"] and told["near"]:
        low, high = told["near"]
        kind = F.when(w < low, 0).when(w <= high, 1)
        counts = (
            edges.select(kind.alias("part"), F.when(kind == 1, w).alias("w"))
            .where("part is not null")
            .groupBy("part", "w")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        own = Scratch(edges.sparkSession, "summary").store(
            counts, below=F.sum(F.when(F.col("part") == 0, F.col("n"))), between=F.sum(F.when(F.col("part") == 1, F.col("n")))
        )
        below, between = (own.metrics[c] or 0 for c in ("below", "between"))
        below += told["n"] - told["known"]  # in order, nulls come first
        places = [(told["n"] - 1) // 2 - below, told["n"] // 2 - below]
        if 0 <= places[0] and places[1] < between:
            median = _median_of_counts(own.df.where("part = 1").select("w", "n"), places)
    if median is None:
        median = exact_median(edges.select("src", "dst", "w"), "w", "src", "dst", rows=told["n"])
    weights = {
        f"{name}_edge_weight": F.lit(told[key]).cast("double")
        for name, key in (("min", "low"), ("max", "high"), ("mean", "mean"))
    }
    return vertices.agg(F.count(F.lit(1)).alias("num_vertices")).select(
        "num_vertices",
        F.lit(told["n"]).cast("long").alias("num_edges"),
        F.lit(len(feature_names)).alias("num_features"),
        F.array(*[F.lit(c) for c in feature_names]).alias("feature_names"),
        *[value.alias(name) for name, value in weights.items()],
        median.scalar().alias("median_edge_weight"),
    )


def edge_count(arcs: DataFrame, symmetric: bool = False) -> DataFrame:
    """One row: number of arcs, halved when every edge is stored in both directions."""
    n = F.count(F.lit(1))
    return arcs.agg((F.expr("count(1) div 2") if symmetric else n).alias("n"))


def bounding_box(vertices: DataFrame, dim: int = 2) -> DataFrame:
    """One row: min and max of each coordinate."""
    aggs = []
    for i in range(dim):
        aggs += [
            F.min(F.col("features")[i]).alias(f"min_{i}"),
            F.max(F.col("features")[i]).alias(f"max_{i}"),
        ]
    return vertices.agg(*aggs)


def cluster_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


def attach_label(components: DataFrame, vertices: DataFrame) -> DataFrame:
    """Features and true label of every clustered vertex."""
    return components.join(vertices, "id")


def label_crosstab(components: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices per (cluster, true label)."""
    return (
        attach_label(components, vertices.select("id", "label"))
        .groupBy("comp", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def run_differences(runs: DataFrame, run_numbers: list[int]) -> DataFrame:
    """(run_a, run_b, diff): ids whose value differs between two runs.

    One row per id with a column per run, then all counts in a single
    aggregation; no pairs of rows are formed.
    """
    wide = runs.groupBy("id").pivot("run", run_numbers).agg(F.first("val"))
    cols = {r: F.col(f"`{r}`") for r in run_numbers}
    counts = wide.agg(
        *[
            F.coalesce(
                F.sum(F.when(cols[a].eqNullSafe(cols[b]), 0).otherwise(1)), F.lit(0)
            ).cast("long").alias(f"d{a}_{b}")
            for i, a in enumerate(run_numbers)
            for b in run_numbers[i + 1 :]
        ],
        F.lit(0).cast("long").alias("zero"),
    )
    cells = [
        F.struct(
            F.lit(a).alias("run_a"),
            F.lit(b).alias("run_b"),
            F.col("zero" if a == b else f"d{min(a, b)}_{max(a, b)}").alias("diff"),
        )
        for a in run_numbers
        for b in run_numbers
    ]
    return counts.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def _xy(vertices: DataFrame) -> DataFrame:
    return vertices.select(
        "id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y")
    )


def cluster_segments(
    merges: DataFrame, vertices: DataFrame, labels: DataFrame, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Plot-ready rows: a vertex, its parent's coordinates, its cluster and colour.

    The colour is the index of the cluster among the sorted clusters, modulo 23.
    Parents and clusters may be shared by very many vertices, hence the look-ups.
    """
    xy, rows = _xy(vertices), vertices.count()
    clusters = labels.select("label").distinct()
    index = assign_ids(clusters, "label", id_col="_index").withColumnRenamed("label", "id")
    base = merges.select("id", "parent").join(xy, "id").join(labels.select("id", "label"), "id")
    base = lookup(base, rows, "parent", xy, rows, {"x": "parent_x", "y": "parent_y"}, limits)
    base = lookup(base, rows, "label", index, index.count(), {"_index": "_index"}, limits)
    return base.select(
        "id", "x", "y", "parent", "parent_x", "parent_y", "label",
        F.pmod("_index", F.lit(COLOURS)).cast("int").alias("colour"),
    )


def forest_segments(
    forest: DataFrame,
    vertices: DataFrame,
    components: DataFrame,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Plot-ready rows of a cut forest: both ends of every edge and its cluster."""
    xy, rows = _xy(vertices), vertices.count()
    ends = xy.join(components.select("id", "comp"), "id")
    first = {"x": "src_x", "y": "src_y", "comp": "comp"}
    both = lookup(forest.select("src", "dst", "w"), rows, "src", ends, rows, first, limits)
    return lookup(both, rows, "dst", xy, rows, {"x": "dst_x", "y": "dst_y"}, limits)
