"""Minimum spanning forests of dense graphs.

Three pieces, all exact under the total order (w, src, dst):

* sparsifier rounds: edges are dealt to bounded buckets, every bucket keeps its
  own spanning forest; an edge dropped there closes a cycle as its heaviest
  edge and can never be in the answer;
* contraction rounds on DataFrames, for whatever is left, of any size;
* once a *counted* remainder is below ``finish_edges`` (a constant), one bounded
  bucket finishes it.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    bucket_count,
    density_exponent,
    edge_budget,
    next_exponent,
    partition_count,
)
from ..lookup import DEFAULT_LIMITS, Limits, flags, lookup
from ..schema import EDGE_SCHEMA, assign_ids, canonical_edges, distinct_vertices, first_n
from ..scratch import Scratch, Stored
from . import kernels, planar
from .contraction import best_of, both_ends, follow_pointers, rank_by_weight, relabel_ranked
from .pairs import BLOCK_ROWS, complete_forest_candidates, dimension, finite

BUCKET_EDGES = 1_000_000  # edges a task reads before it squeezes them
FOREST_EDGES = 1_000_000  # largest forest of one bucket
WORTHWHILE = 0.9  # a round that keeps more than this share is the last one
LINE_ROWS = 50_000
PLANAR_ROWS = 50_000
MAX_TASKS = 20_000


@dataclass
class Forest:
    """``edges``: the forest. ``rounds``: edges before and after each sparsifier round."""

    edges: DataFrame
    rounds: list[tuple[int, int]] = field(default_factory=list)
    vertices: int = 0
    size: int | None = None
    work: dict = field(default_factory=dict)


def _forest_filter(flagged: bool, weight=np.float64):
    """Group function: spanning forest of a bucket, reading it in chunks.

    Only the forest so far and one chunk are held, so a bucket may be larger
    than memory as long as its forest is not.
    """

    def batch(cols, mask, kept):
        arrays = [pa.array(c[mask]) for c in cols]
        names = ["src", "dst", "w"]
        if flagged:
            arrays.append(pa.array(np.full(int(mask.sum()), kept)))
            names.append("kept")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(
        key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        kept = [np.array([], np.int64), np.array([], np.int64), np.array([], weight)]
        waiting, held = [], 0

        def squeeze():
            cols = [
                np.concatenate([old] + [w[i] for w in waiting]) for i, old in enumerate(kept)
            ]
            return cols, kernels.forest_mask(*cols)

        for b in batches:
            waiting.append([b.column(n).to_numpy(zero_copy_only=False) for n in ("src", "dst", "w")])
            held += b.num_rows
            if held >= max(BUCKET_EDGES, len(kept[0])):
                cols, mask = squeeze()
                if flagged:
                    yield batch(cols, ~mask, False)
                kept, waiting, held = [c[mask] for c in cols], [], 0
        cols, mask = squeeze()
        if flagged:
            yield batch(cols, ~mask, False)
        yield batch(cols, mask, True)

    return run


def _flag_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags of edges that come by bucket and, inside it, in total order.

    An edge is kept if no earlier ones connect its ends. A task holds one chunk and, of the
    current bucket, a component per vertex.
    """
    trees, current, waiting, held = kernels.GrowingTrees(), None, [], 0

    def flagged():
        cols = [np.concatenate([w[i] for w in waiting]) for i in range(3)]
        kept = trees.add(cols[0], cols[1])
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c) for c in cols), pa.array(kept)], names=["src", "dst", "w", "kept"]
        )

    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("src", "dst", "w")]
        bucket = batch.column("_bucket")
        # no bucket is a bucket of its own
        none = bucket.is_null().to_numpy(zero_copy_only=False)
        number = bucket.fill_null(0).to_numpy(zero_copy_only=False)
        new = (none[1:] != none[:-1]) | (number[1:] != number[:-1])
        heads = np.flatnonzero(np.r_[True, new][: len(none)])
        for start, end in zip(heads, np.r_[heads[1:], len(none)]):
            own = (bool(none[start]), int(number[start]))
            if own != current or held >= BUCKET_EDGES:
                if waiting:
                    yield flagged()
                waiting, held = [], 0
            if own != current:
                trees, current = kernels.GrowingTrees(), own
            waiting.append([c[start:end] for c in cols])
            held += end - start
    if waiting:
        yield flagged()


def _bucketed(edges: DataFrame, bucket: Column, buckets: int):
    spread = edges.select("src", "dst", "w", bucket.cast("long").alias("_bucket"))
    return spread.repartition(max(1, min(buckets, MAX_TASKS)), "_bucket").groupBy("_bucket")


def bucket_msf(edges: DataFrame, bucket: Column, buckets: int) -> DataFrame:
    """(src, dst, w, kept): every edge, with whether its bucket's forest keeps it.

    Spark sorts the edges of a bucket, so a bucket may be larger than memory, and so may its forest.
    """
    weight = F.coalesce("w", F.lit(float("nan"))).alias("w")
    spread = edges.select("src", "dst", weight, bucket.cast("long").alias("_bucket"))
    ordered = spread.repartition(max(1, min(buckets, MAX_TASKS)), "_bucket").sortWithinPartitions(
        "_bucket", "w", "src", "dst"
    )
    return ordered.mapInArrow(_flag_in_order, EDGE_SCHEMA + ", kept boolean")


def bucket_forests(edges: DataFrame, bucket: Column, buckets: int) -> DataFrame:
    """Union of the spanning forests of all buckets."""
    return _bucketed(edges, bucket, buckets).applyInArrow(_forest_filter(False), EDGE_SCHEMA)


def removed_edges(flagged: DataFrame) -> DataFrame:
    """The edges that some bucket dropped."""
    return flagged.where(~F.col("kept")).select("src", "dst", "w").distinct()


def edge_bucket(buckets: int, salt) -> Column:
    """Bucket of an edge; the salt changes from round to round so buckets never repeat."""
    return F.pmod(F.xxhash64("src", "dst", F.lit(salt)), F.lit(buckets).cast("long"))


def vertex_pair_bucket(parts: int, salt) -> Column:
    """Bucket of an edge by the unordered pair of the parts its ends are hashed to."""
    a, b = (F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(parts).cast("long")) for c in ("src", "dst"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.shiftright(hi * (hi + 1), 1) + lo


def sparsify_hash(edges: DataFrame, n: int, m: int, epsilon: float, salt) -> tuple[DataFrame, int]:
    """One round over edge-hash buckets of about n^(1+epsilon) edges.

    A bucket's forest can have n edges; beyond FOREST_EDGES buckets get smaller.
    """
    x = bucket_count(n, m, epsilon)
    if n > FOREST_EDGES:
        x = max(x, math.ceil(m / FOREST_EDGES))
    return bucket_forests(edges, edge_bucket(x, salt), x), x


def _part_count(
    edges: DataFrame, n: int, m: int, c: float, epsilon: float, limits: Limits
) -> int:
    """Number of vertex parts.

    Two parts together never exceed FOREST_EDGES vertices, which bounds the
    forest a task holds; the edges of a bucket only stream past it. There are
    enough buckets for all cores as far as the graph is dense enough: about
    n * (k + 1) edges survive, so k stays well below the average degree.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    spread = min(math.ceil(math.sqrt(2.0 * cores)), m // (4 * max(n, 1)))
    k = max(partition_count(n, c, epsilon), math.ceil(2.0 * n / FOREST_EDGES))
    return max(k, spread, 2) if m > limits.finish_edges else k


def sparsify_vertex_partition(edges: DataFrame, k: int, salt) -> tuple[DataFrame, int]:
    """One round over pairs of vertex parts: each bucket is dense, so most edges go."""
    pairs = k * (k + 1) // 2
    return bucket_forests(edges, vertex_pair_bucket(k, salt), pairs), pairs


def sparsify_two_way(edges: DataFrame, k: int, salt) -> tuple[DataFrame, int]:
    """One round over two independent vertex partitions: k x k blocks.

    An edge goes to the block of either orientation and stays if neither drops
    it. Fewer edges stay than with one partition, for twice the shuffled rows.
    """

    def part(end: str, side: str) -> Column:
        return F.pmod(F.xxhash64(end, F.lit(f"{salt}/{side}")), F.lit(k).cast("long"))

    one, other = part("src", "u") * k + part("dst", "v"), part("dst", "u") * k + part("src", "v")
    sent = edges.withColumn("_block", F.explode(F.array_distinct(F.array(one, other))))
    kept = bucket_forests(sent, F.col("_block"), k * k)
    both = (
        kept.groupBy("src", "dst")
        .agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == F.when(one == other, 1).otherwise(2))
    )
    return both.select("src", "dst", "w"), k * k


def contraction_forest(
    scratch: Scratch, edges: DataFrame, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Minimum spanning forest by contraction rounds on DataFrames.

    Each round every live vertex picks its first edge in rank order, picked
    edges enter the forest, and the graph is contracted along them, so the live
    vertices at least halve. A remainder of at most ``limits.finish_edges`` is
    finished by one bounded bucket.
    """
    ranked = rank_by_weight(scratch, edges)
    live = Stored(
        ranked.df.select(F.col("src").alias("a"), F.col("dst").alias("b"), "r"), ranked.rows, ""
    )
    picked = None
    while live.rows > limits.finish_edges:
        small = live.rows <= limits.broadcast_rows
        best = scratch.store(best_of(both_ends(live.df)), small=small)
        chosen = best.df.select("r")
        picked = chosen if picked is None else picked.union(chosen)
        links = best.df.select("id", F.col("nbr").alias("ptr"))
        roots = follow_pointers(scratch, links, best.rows, limits, path_min=False)
        merged = relabel_ranked(live.df, live.rows, ("a", "b"), roots, "leader", limits)
        lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        done, live = live, scratch.store(
            merged.where(F.col("a") != F.col("b"))
            .select(lo, hi, "r")
            .groupBy("a", "b")
            .agg(F.min("r").alias("r")),
            small=small,
        )
        scratch.drop(done)
    if live.rows:
        rest = live.df.select(
            F.col("a").alias("src"), F.col("b").alias("dst"), F.col("r").alias("w")
        )
        last = (
            _bucketed(rest, F.lit(0), 1)
            .applyInArrow(_forest_filter(False, np.int64), "src long, dst long, w long")
            .select(F.col("w").alias("r"))
        )
        picked = last if picked is None else picked.union(last)
    if picked is None:
        return ranked.df.select("src", "dst", "w")
    return ranked.df.join(picked, "r", "left_semi").select("src", "dst", "w")


def minimum_spanning_forest(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    epsilon: float = 0.125,
    sparsifier: str | None = "vertex",
    seed: int = 0,
    limits: Limits = DEFAULT_LIMITS,
    canonical: bool = False,
    warn: bool = False,
) -> Forest:
    """The unique minimum spanning forest under (w, src, dst).

    While there are more than n^(1+epsilon) edges a sparsifier round runs
    ('vertex' pairs of vertex parts, 'two_way' blocks, 'hash' buckets, or None), stopping early if
    a round hardly removes anything; contraction rounds solve the rest. ``canonical``
    says that ``edges`` is already oriented and free of duplicates.
    """
    if sparsifier not in ("vertex", "two_way", "hash", None):
        raise ValueError(f"unknown sparsifier {sparsifier!r}")
    scratch = Scratch(edges.sparkSession, "forest")
    edges = edges.select("src", "dst", "w").where(F.col("w").isNotNull() & ~F.isnan("w"))
    live = scratch.store(edges if canonical else canonical_edges(edges))
    n = (vertices.select("id") if vertices is not None else distinct_vertices(live.df)).count()
    c, rounds, solved = density_exponent(n, live.rows), [], False
    while sparsifier and live.rows > edge_budget(n, epsilon):
        salt = f"{seed}/{len(rounds)}"
        if sparsifier == "hash":
            kept, buckets = sparsify_hash(live.df, n, live.rows, epsilon, salt)
        else:
            k = _part_count(live.df, n, live.rows, c, epsilon, limits)
            shrink = sparsify_two_way if sparsifier == "two_way" else sparsify_vertex_partition
            kept, buckets = shrink(live.df, k, salt)
        done, live = live, scratch.store(kept)
        scratch.drop(done)
        rounds.append((done.rows, live.rows))
        solved = buckets == 1
        if solved or live.rows > WORTHWHILE * done.rows:
            break
        c = next_exponent(c, epsilon)
    if solved:
        result = live.df
    elif live.rows <= limits.finish_edges:
        result = bucket_forests(live.df, F.lit(0), 1)
    else:
        result = contraction_forest(scratch, live.df, limits)
    forest = Forest(result, rounds, n)
    if warn:
        stored = scratch.store(result)
        forest.edges, forest.size = stored.df, stored.rows
        if stored.rows < n - 1:
            warnings.warn(f"not connected: {stored.rows} forest edges for {n} vertices")
    return forest


def complete_forest(
    vertices: DataFrame,
    metric: str = "euclidean",
    epsilon: float = 0.125,
    block_rows: int = BLOCK_ROWS,
    limits: Limits = DEFAULT_LIMITS,
    line_rows: int = LINE_ROWS,
    planar_rows: int = PLANAR_ROWS,
) -> Forest:
    """Minimum spanning forest of the complete graph over points.

    The first sparsifier round is fused with the distances, so the n(n-1)/2
    edges never exist as rows. More than ``line_rows`` points on a line are
    only sorted; of more than ``planar_rows`` points in two or three dimensions only those
    are compared that can be neighbours in the tree (``planar``). A point with an
    undefined or infinite coordinate has no edges.
    """
    n = vertices.count()
    points = finite(vertices)
    flat = metric in ("euclidean", "manhattan") and n > min(line_rows, planar_rows)
    dim = dimension(points) if flat else 0
    if n > line_rows and dim == 1:
        return Forest(line_forest(points, n, limits), [], n)
    candidates, work = None, {}
    if n > planar_rows and dim in planar.CURVE_BITS:
        candidates, work = _planar_edges(points, metric, dim, min(block_rows, planar.BLOCK_ROWS), limits)
    if candidates is None:
        candidates = complete_forest_candidates(points, metric, block_rows, rows=n)
    forest = minimum_spanning_forest(
        candidates,
        vertices,
        epsilon,
        limits=limits,
        canonical=True,
    )
    forest.work = work
    return forest


def _planar_edges(
    points: DataFrame, metric: str, dim: int, block_rows: int, limits: Limits
) -> tuple[DataFrame, dict]:
    """Candidates of ``planar``; copies of a point hang on their smallest id and take no part."""
    scratch = Scratch(points.sparkSession, "places")
    plain = points.where("id is not null").select(
        F.col("id").cast("long").alias("id"), F.transform("features", lambda v: v.cast("double")).alias("features")
    )
    places = scratch.store(plain.groupBy("features").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    edges, work = planar.planar_candidates(places.df, metric, dim, places.rows, block_rows)
    several = scratch.store(places.df.where("n > 1").select(F.col("features").alias("id"), F.col("id").alias("first")))
    if not several.rows:
        return edges, work
    told = lookup(plain, plain.count(), "features", several.df, several.rows, {"first": "first"}, limits)
    copies = told.where(F.col("id") != F.col("first")).select(
        F.col("first").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w")
    )
    return edges.unionByName(copies), work


def line_forest(vertices: DataFrame, rows: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Spanning tree of points on a line: neighbours in sorted order, copies to their first id."""
    points = vertices.select(
        F.col("id").cast("long").alias("point"), F.col("features")[0].cast("double").alias("x")
    )
    places = assign_ids(
        points.groupBy("x").agg(F.min("point").alias("first")), "x", id_col="pos"
    )
    after = places.select(
        (F.col("pos") - 1).alias("pos"), F.col("x").alias("nx"), F.col("first").alias("nfirst")
    )
    steps = places.join(after, "pos").select(
        F.least("first", "nfirst").alias("src"),
        F.greatest("first", "nfirst").alias("dst"),
        F.abs(F.col("nx") - F.col("x")).alias("w"),
    )
    table = places.select(F.col("x").alias("id"), "first")
    copies = lookup(points, rows, "x", table, places.count(), {"first": "first"}, limits)
    same = copies.where(F.col("point") != F.col("first")).select(
        F.col("first").alias("src"), F.col("point").alias("dst"), F.lit(0.0).alias("w")
    )
    return steps.unionByName(same)


# --- ordering, cutting, filtering ---------------------------------------------------


def heaviest_edges(forest: DataFrame, count: int) -> DataFrame:
    """The ``count`` heaviest edges, ties by (src, dst)."""
    return first_n(forest, count, F.col("w").desc(), "src", "dst")


def edges_sorted(edges: DataFrame, descending: bool = False) -> DataFrame:
    """Edges in total order."""
    weight = F.col("w").desc() if descending else F.col("w")
    return edges.orderBy(weight, "src", "dst")


def remove_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges whose (src, dst) is not in ``removed``."""
    return edges.join(removed.select("src", "dst"), ["src", "dst"], "left_anti").select(
        *edges.columns
    )


def cut_heaviest(forest: DataFrame, k: int) -> DataFrame:
    """The forest without its k-1 heaviest edges."""
    return remove_edges(forest, heaviest_edges(forest, k - 1)) if k > 1 else forest


def edges_between(
    edges: DataFrame, u: DataFrame, v: DataFrame, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Edges with one end in ``u`` and the other in ``v``, in either stored orientation."""
    own = Scratch(edges.sparkSession, "between").store(edges.select("src", "dst", "w"))
    marked = flags(own.df, own.rows, ["src", "dst"], {"u": u, "v": v}, limits)
    crossing = (F.col("src_u") & F.col("dst_v")) | (F.col("src_v") & F.col("dst_u"))
    return marked.where(crossing).select("src", "dst", "w").distinct()


def forest_in_cluster(
    forest: DataFrame, cluster: DataFrame, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Forest edges whose first end belongs to ``cluster``."""
    own = Scratch(forest.sparkSession, "in-cluster").store(forest.select("src", "dst", "w"))
    marked = flags(own.df, own.rows, ["src"], {"in": cluster}, limits)
    return marked.where("src_in").select("src", "dst", "w")
