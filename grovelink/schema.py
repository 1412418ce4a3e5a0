"""Table shapes shared by all operators, and the conversions between them.

vertices(id LONG, features ARRAY<DOUBLE>, label DOUBLE)
edges(src LONG, dst LONG, w DOUBLE)   undirected: src < dst, one row per pair
arcs(src LONG, dst LONG, w DOUBLE)    directed
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import DEFAULT_LIMITS, Limits, lookup
from .scratch import Scratch

TOP_ROWS = 1_000  # of every task, so what one task merges stays small
EDGE_SCHEMA = "src long, dst long, w double"


def oriented(edges: DataFrame) -> DataFrame:
    """Orient every edge to (smaller id, larger id)."""
    return edges.select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w"
    )


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected simple graph: oriented, no self loops, lightest of parallel edges."""
    return (
        oriented(edges)
        .where(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.min("w").alias("w"))
    )


def edges_to_arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, in one pass over ``edges``."""
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return edges.select(F.explode(ends).alias("_e"), "w").select("_e.src", "_e.dst", "w")


def distinct_vertices(edges: DataFrame) -> DataFrame:
    """Every id that is an end of some edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def assign_ids(df: DataFrame, *order_by: str | Column, id_col: str = "id") -> DataFrame:
    """Dense ids 0..n-1 in the given order (or in partition order when none is given).

    The rows are range-sorted and numbered inside their partitions; only the row
    count per partition is gathered to turn these numbers into dense ones.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ids")
    ordered = df.orderBy(*order_by) if order_by else df
    stored = scratch.store(ordered.withColumn("_mono", F.monotonically_increasing_id()))
    part, row = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND((1 << 33) - 1)
    counts = stored.df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the sort, so this window is over task metadata only
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_off")
    )
    return (
        stored.df.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select((F.col("_off") + row).alias(id_col), *df.columns)
    )


def first_n(df: DataFrame, count: int, *order_by: str | Column) -> DataFrame:
    """The first ``count`` rows in the given order.

    A small count is a top-k that every task cuts to k rows; a large one is a
    filter on positions of a distributed sort, so no task holds all of them.
    """
    if count <= TOP_ROWS:
        return df.orderBy(*order_by).limit(count)
    return assign_ids(df, *order_by, id_col="_pos").where(F.col("_pos") < count).drop("_pos")


def nested_adjacency(
    arcs: DataFrame, max_entries: int = 100_000, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """adj(id, part, nbrs ARRAY<STRUCT<dst,w>>): neighbour lists sorted by (w, dst).

    A vertex with more than ``max_entries`` arcs is split over several parts, so
    that no single row has to hold an unbounded list.
    """
    stored = Scratch(arcs.sparkSession, "adjacency").store(arcs)
    degree = stored.df.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_deg"))
    heavy = degree.where(F.col("_deg") > max_entries).select(
        "id", F.ceil(F.col("_deg") / max_entries).cast("long").alias("_parts")
    )
    heavy_rows = stored.rows // max_entries + 1
    tagged = lookup(stored.df, stored.rows, "src", heavy, heavy_rows, {"_parts": "_parts"}, limits)
    return (
        tagged.withColumn("part", F.expr("pmod(xxhash64(dst), coalesce(_parts, 1L))"))
        .groupBy(F.col("src").alias("id"), "part")
        .agg(F.array_sort(F.collect_list(F.struct("w", "dst"))).alias("_n"))
        .select(
            "id",
            "part",
            F.transform(
                "_n", lambda e: F.struct(e["dst"].alias("dst"), e["w"].alias("w"))
            ).alias("nbrs"),
        )
    )


def explode_adjacency(adjacency: DataFrame) -> DataFrame:
    """Flatten nested neighbour lists back to arcs(src, dst, w)."""
    return adjacency.select(F.col("id").alias("src"), F.explode("nbrs").alias("_n")).select(
        "src", F.col("_n.dst").alias("dst"), F.col("_n.w").alias("w")
    )
