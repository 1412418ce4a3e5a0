"""Ward and average linkage of clusters that a graph connects.

Every round finds the best neighbour of each cluster and merges all pairs that chose each
other, so a round is a few grouped joins and most hierarchies need few of them. Clusters keep sums
(Ward: number and coordinate sums; average: total and number of the links between two
clusters), from which all distances follow; no distance between unlinked clusters is computed.

Ward's height of a merge is sqrt(2 * a * b / (a + b)) times the distance of the two centres, a and b
being the sizes; the height of average linkage is the mean weight of the links between the two.
On a complete graph both give the same merges as one merge at a time, ties aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..schema import canonical_edges
from ..scratch import Scratch, Stored
from .pairs import dimension, finite

MERGES = "round int, src long, dst long, w double, n long"


def _relabelled(links: Stored, moves: Stored, limits: Limits) -> DataFrame:
    """Links with new ends, oriented, without those inside a cluster."""
    out = links.df
    for end in ("src", "dst"):
        out = lookup(out, links.rows, end, moves.df, moves.rows, {"to": f"_{end}"}, limits)
        out = out.withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    rest = [c for c in out.columns if c not in ("src", "dst")]
    return out.where("src <> dst").select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest
    )


def connected_linkage(
    edges: DataFrame,
    vertices: DataFrame,
    method: str = "ward",
    max_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """merges(round, src, dst, w, n): cluster dst joins cluster src at height w, and both hold n vertices.

    A cluster is named by its smallest id. Ties go to the smaller (src, dst). The merges are
    a forest over the vertices, so ``cut_clusters`` cuts them at any number of clusters.
    Ward needs features, average linkage takes the weights. Vertices with an undefined or infinite
    coordinate (Ward), links to unknown vertices and links without a finite weight (average) take no part.
    Merges under a graph may be lower than those before them.
    """
    if method not in ("ward", "average"):
        raise ValueError(f"unknown method {method!r}")
    scratch = Scratch(edges.sparkSession, "linkage")
    ward = method == "ward"
    known = finite(vertices) if ward else vertices
    dim = dimension(known) if ward else 0
    axes = [f"x{i}" for i in range(dim)]
    clusters = scratch.store(
        known.select(
            F.col("id").cast("long").alias("id"),
            F.lit(1).cast("long").alias("n"),
            *[F.col("features")[i].cast("double").alias(x) for i, x in enumerate(axes)],
        )
    )
    given = edges.select("src", "dst", F.lit(0.0).alias("w") if ward else F.col("w"))
    given = given.where("src is not null and dst is not null and abs(w) < double('infinity')")
    for end in ("src", "dst"):
        given = given.join(clusters.df.select(F.col("id").alias(end)), end, "left_semi")
    links = scratch.store(
        canonical_edges(given).select("src", "dst", F.col("w").alias("total"), F.lit(1).cast("long").alias("links"))
    )
    # a broadcast table is bounded by its width as well
    narrow = Limits(limits.broadcast_rows // (dim + 1), limits.pointer_rows, limits.finish_edges, limits.heavy_share)
    merges: list[Stored] = []
    while links.rows and (max_rounds is None or len(merges) < max_rounds):
        told = links.df
        for end in ("src", "dst"):
            values = {c: f"{end}_{c}" for c in ("n", *axes)}
            told = lookup(told, links.rows, end, clusters.df, clusters.rows, values, narrow)
        height = F.col("total") / F.col("links")
        if ward:
            parts = [F.col(f"src_{x}") / F.col("src_n") - F.col(f"dst_{x}") / F.col("dst_n") for x in axes]
            squares = sum((p * p for p in parts[1:]), parts[0] * parts[0])
            a, b = F.col("src_n"), F.col("dst_n")
            height = F.sqrt(2.0 * a * b / (a + b) * squares)
        n = (F.col("src_n") + F.col("dst_n")).alias("n")
        weighed = scratch.store(told.select("src", "dst", height.alias("w"), n))
        ends = F.explode(F.array("src", "dst")).alias("id")
        best = weighed.df.select(ends, F.struct("w", "src", "dst", "n").alias("link")).groupBy("id").agg(F.min("link").alias("link"))
        chosen = best.groupBy("link").count().where("count = 2")
        done = scratch.store(
            chosen.select(F.lit(len(merges) + 1).alias("round"), "link.src", "link.dst", "link.w", "link.n")
        )
        merges.append(done)
        moves = scratch.store(done.df.select(F.col("dst").alias("id"), F.col("src").alias("to")))
        old = (clusters, links, weighed, moves)
        links = scratch.store(
            _relabelled(links, moves, limits).groupBy("src", "dst").agg(F.sum("total").alias("total"), F.sum("links").alias("links"))
        )
        moved = lookup(clusters.df, clusters.rows, "id", moves.df, moves.rows, {"to": "_to"}, limits)
        clusters = scratch.store(
            moved.groupBy(F.coalesce("_to", "id").alias("id")).agg(*[F.sum(c).alias(c) for c in ("n", *axes)])
        )
        scratch.drop(*old)
    if not merges:
        return edges.sparkSession.createDataFrame([], MERGES)
    # one folder per round, read as one table
    return edges.sparkSession.read.schema(MERGES).parquet(*[m.path for m in merges])
