"""One linkage round: best neighbour, leader, relabel, contract.

The iterative operators share these steps. Internally an arc carries the LONG
rank of its edge in the total order (w, smaller id, larger id), so "lightest,
ties by id" is a plain ``min`` of a LONG with map-side partial aggregation.
"""

from __future__ import annotations

from typing import Iterator, Tuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..scratch import Scratch, Stored
from . import kernels


def rank_by_weight(scratch: Scratch, edges: DataFrame) -> Stored:
    """Add ``r``: increasing in (w, smaller id, larger id, src), unique per row.

    A range sort plus the in-partition row number gives an order-preserving
    LONG without gathering rows; storing it freezes the numbering.
    """
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    ordered = edges.orderBy("w", lo, hi, "src")
    return scratch.store(ordered.withColumn("r", F.monotonically_increasing_id()))


def both_ends(edges: DataFrame) -> DataFrame:
    """(id, nbr, r) for both directions of ranked undirected edges (a, b, r)."""
    ends = F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("nbr")),
        F.struct(F.col("b").alias("id"), F.col("a").alias("nbr")),
    )
    return edges.select(F.explode(ends).alias("_e"), "r").select("_e.id", "_e.nbr", "r")


def best_of(ends: DataFrame) -> DataFrame:
    """best(id, nbr, r): the first arc of every vertex in rank order."""
    return ends.groupBy("id").agg(F.min("r").alias("r"), F.min_by("nbr", "r").alias("nbr"))


def relabel_ranked(
    edges: DataFrame, rows: int, ends: tuple[str, str], table: Stored, value: str, limits: Limits
) -> DataFrame:
    """Replace both ends by ``table[value]``, ends without a row keep their id."""
    for end in ends:
        edges = lookup(edges, rows, end, table.df, table.rows, {value: "_to"}, limits)
        edges = edges.withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges


def _follow_small(links: DataFrame, path_min: bool) -> DataFrame:
    """(id, nbr, leader) of a pointer table whose row count was checked to be small."""

    def follow(
        key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, nbr = table.column("id").to_numpy(), table.column("ptr").to_numpy()
        leader = kernels.follow_pointers(ids, nbr, path_min)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(nbr), pa.array(leader)], names=["id", "nbr", "leader"]
        )

    one = links.withColumn("_one", F.lit(0)).groupBy("_one")
    return one.applyInArrow(follow, "id long, nbr long, leader long")


def _break_pairs(links: DataFrame) -> DataFrame:
    """Let the smaller of two vertices that point at each other point at itself."""
    other = links.select(F.col("id").alias("_id"), F.col("ptr").alias("_ptr"))
    mutual = (F.col("ptr") == F.col("_id")) & (F.col("id") == F.col("_ptr"))
    return links.join(other, mutual, "left").select(
        "id",
        F.when(F.col("_id").isNotNull(), F.least("id", "ptr")).otherwise(F.col("ptr")).alias("ptr"),
    )


def _step_root(df: DataFrame, rows: int, limits: Limits) -> DataFrame:
    up = lookup(df, rows, "leader", df, rows, {"leader": "_up"}, limits)
    to = F.coalesce("_up", "leader")
    moved = (to != F.col("leader")).cast("long").alias("_moved")
    return up.select("id", "nbr", to.alias("leader"), moved)


def _step_min(df: DataFrame, rows: int, limits: Limits) -> DataFrame:
    far = lookup(df, rows, "ptr", df, rows, {"ptr": "_ptr", "leader": "_m"}, limits)
    m = F.least("leader", F.coalesce("_m", "ptr"))
    moved = (m < F.col("leader")).cast("long").alias("_moved")
    return far.select("id", "nbr", F.coalesce("_ptr", "ptr").alias("ptr"), m.alias("leader"), moved)


def follow_pointers(
    scratch: Scratch, links: DataFrame, rows: int, limits: Limits, path_min: bool, **metrics
) -> Stored:
    """links(id, ptr) -> (id, nbr = ptr, leader).

    With ``path_min`` the leader is the smallest id on the forward path of any
    self-map; otherwise the links form trees that end in a loop or in two vertices
    that point at each other, and the leader is that vertex or the smaller of
    the two. Pointer doubling by self-joins covers 2^k steps after k
    jobs; once nothing changes in a step, nothing ever will. ``rows`` bounds the
    table; below ``limits.pointer_rows`` one bounded task does the following.
    """
    if rows <= limits.pointer_rows:
        return scratch.store(_follow_small(links, path_min), small=True, **metrics)
    if not path_min:
        links = scratch.store(_break_pairs(links)).df
    state = links.select("id", F.col("ptr").alias("nbr"), "ptr")
    state = state.withColumn("leader", F.col("id" if path_min else "ptr"))
    last = None
    while True:
        step = (_step_min if path_min else _step_root)(state, rows, limits)
        table = scratch.store(step, hide=("_moved",), moved=F.sum("_moved"), **metrics)
        scratch.drop(last)
        if not table.metrics.get("moved"):
            return table
        state, rows, last = table.df, table.rows, table


# --- the single steps as operators on plain tables ---------------------------------


def best_neighbours(arcs: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """best(id, nbr, w): nearest neighbour of every vertex, ties by the smaller id.

    With ``vertices``, a vertex without arcs is its own neighbour.
    """
    best = (
        arcs.groupBy(F.col("src").alias("id"))
        .agg(F.min(F.struct("w", "dst")).alias("_b"))
        .select("id", F.col("_b.dst").alias("nbr"), F.col("_b.w").alias("w"))
    )
    if vertices is None:
        return best
    return (
        vertices.select("id")
        .join(best, "id", "left")
        .select("id", F.coalesce("nbr", "id").alias("nbr"), "w")
    )


def find_leaders(
    best: DataFrame, mode: str = "path_min", limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """leaders(id, leader) of a best-neighbour map (id, nbr).

    ``path_min``: smallest id on the forward path of best neighbours.
    ``component_min``: smallest id of the whole connected group.
    """
    if mode == "component_min":
        from .components import connected_components

        links = best.select(F.col("id").alias("src"), F.col("nbr").alias("dst"))
        comps = connected_components(links, best.select("id"), limits=limits)
        return comps.select("id", F.col("comp").alias("leader"))
    if mode != "path_min":
        raise ValueError(f"unknown leader mode {mode!r}")
    scratch = Scratch(best.sparkSession, "leaders")
    links = scratch.store(best.select("id", F.col("nbr").alias("ptr")))
    done = follow_pointers(scratch, links.df, links.rows, limits, path_min=True)
    return done.df.select("id", "leader")


def relabel(arcs: DataFrame, leaders: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Replace both ends of every arc by their leaders."""
    scratch = Scratch(arcs.sparkSession, "relabel")
    stored, table = scratch.store(arcs), scratch.store(leaders.select("id", "leader"))
    return relabel_ranked(stored.df, stored.rows, ("src", "dst"), table, "leader", limits)


def drop_internal(arcs: DataFrame) -> DataFrame:
    """Drop arcs whose two ends have the same leader."""
    return arcs.where(F.col("src") != F.col("dst"))


def contract(arcs: DataFrame, leaders: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Arcs between leaders; parallel arcs become one of the smallest weight."""
    return (
        drop_internal(relabel(arcs, leaders, limits))
        .groupBy("src", "dst")
        .agg(F.min("w").alias("w"))
    )
