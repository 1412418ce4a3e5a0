"""Perturbed complete graphs whose pairs never exist as rows.

The draw of a pair is a hash of the seed and its two ids, so a task that holds two blocks of
points makes the weights of all their pairs, for every run, and gives only what can matter
later: the spanning forest of the block pair, or the k lightest arcs of each vertex.
Values are those of ``perturb_weights`` and ``bucketize`` on the rows of ``all_pairs``.

A draw moves a weight by a bounded share of itself, so distances tell which pairs can matter: in few
dimensions the heaviest pair is looked for among far points only (``max_perturbed_weight``), and the
k lightest arcs of a vertex within a radius of its own (``perturbed_nearest``); spanning forests need the
pairs that the plain forest doesn't connect by much shorter steps (``perturbed_forests``).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from hashlib import md5
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import TWO_32
from ..functions.weights import PERTURB_SCALE, bucket_number
from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..scratch import Scratch, Stored
from . import grid, kernels
from .components import connected_components
from .pairs import MAX_TASKS, _block_pairs, _pair_index, _read_group, dimension, eps_join, finite, knn

FEW_DRAWS = 64
HASHED_AT_ONCE = 8192
HEAD_BYTES = 15  # with two numbers and a bar, what is hashed fits into one block of md5
MD5_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
MD5_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
# a block pair has at most the square of it in pairs, whose weights a task holds at once
BLOCK_ROWS = 512
CHUNK_PAIRS = 200_000  # pairs a task reads before it draws and squeezes them
HELD_EDGES = 4_000_000  # edges of all runs that a task holds
ROUNDING = 1e-9
FAR_ROWS = 4096  # points whose pairs are measured without looking at boxes first
FAR_CELLS = 2048  # boxes of points that the driver compares
FAR_DEPTH = {1: 10, 2: 5, 3: 3}  # by dimension: an axis is first cut into 2 ** that many cells
FAR_DRAWS = 50_000  # pairs whose draws give a first bound
LEVELS = (0.7, 0.4, 0.1, 0.025, 0.006)  # shares of the longest edge, whose clusters bound what pairs are drawn
FINE_LEVELS = tuple(0.97**i for i in range(1, 48)) + LEVELS[2:]  # of a tree that one task holds
TASK_ROWS = 2000  # places for which a task draws pairs
HASHED = 8  # lists that the copies of a place are dealt to
LISTED = 512  # copies in a list
BOUND_COPIES = 32  # copies of a place whose pairs are drawn for a first bound
FINEST = 45  # no cell is smaller than 2 ** -that of the largest coordinate


def draws(seed, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The uniform numbers of ``hashed_uniform(seed, a, b)``."""
    head = f"{seed}|"
    a, b = np.asarray(a), np.asarray(b)
    if len(a) < FEW_DRAWS or a.dtype.kind != "i" or b.dtype.kind != "i" or len(head.encode()) > HEAD_BYTES or min(a.min(), b.min()) < 0:
        raw = b"".join(
            [md5(f"{head}{x}|{y}".encode()).digest()[:4] for x, y in zip(a.tolist(), b.tolist())]
        )
        return np.frombuffer(raw, dtype=">u4") / TWO_32
    out = np.empty(len(a), dtype=np.uint32)
    powers = 10 ** np.arange(1, 19, dtype=np.int64)
    kind = np.searchsorted(powers, a, "right") * 32 + np.searchsorted(powers, b, "right")
    for one in np.unique(kind):
        at = np.flatnonzero(kind == one)
        for start in range(0, len(at), HASHED_AT_ONCE):
            some = at[start : start + HASHED_AT_ONCE]
            out[some] = _md5_heads(head.encode(), a[some], one // 32 + 1, b[some], one % 32 + 1)
    return out.byteswap() / TWO_32


def _md5_heads(head: bytes, a: np.ndarray, digits_a: int, b: np.ndarray, digits_b: int) -> np.ndarray:
    """First words of the md5 of ``head``, a, a bar, b, for numbers of so many digits."""
    words = np.zeros((16, len(a)), dtype=np.uint32)
    for i, byte in enumerate(head):
        words[i // 4] |= np.uint32(byte << 8 * (i % 4))
    end = len(head)
    for x, digits, after in ((a, digits_a, ord("|")), (b, digits_b, 0x80)):
        for i in range(end + digits - 1, end - 1, -1):
            rest = x // 10
            words[i // 4] |= (x - rest * 10 + ord("0")).astype(np.uint32) << np.uint32(8 * (i % 4))
            x = rest
        end += digits + 1
        words[(end - 1) // 4] |= np.uint32(after << 8 * ((end - 1) % 4))
    words[14] = (end - 1) * 8
    used = {*range((end + 3) // 4), 14}
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    p, q, r, s = (np.full(len(a), x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            mix, g = s ^ (q & (r ^ s)), i
        elif i < 32:
            mix, g = r ^ (s & (q ^ r)), (5 * i + 1) % 16
        elif i < 48:
            mix, g = q ^ r ^ s, (3 * i + 5) % 16
        else:
            mix, g = r ^ (q | ~s), 7 * i % 16
        mix += p
        mix += MD5_ADDED[i]
        if g in used:
            mix += words[g]
        turn = MD5_TURNS[i // 16][i % 4]
        turned = mix << np.uint32(turn)
        turned |= mix >> np.uint32(32 - turn)
        turned += q
        p, q, r, s = s, turned, q, r
    return p + start[0]


def perturbed(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, gamma: float, seed) -> np.ndarray:
    shift = (2.0 * draws(seed, lo, hi) - 1.0) * gamma * w
    return PERTURB_SCALE * np.maximum(w + shift, 0.0)


def numbered(w: np.ndarray, bounds: list[tuple[float, float]]) -> np.ndarray:
    """Bucket numbers instead of the weights inside the buckets."""
    upper = np.array([hi for _, hi in bounds])
    number = np.searchsorted(upper[:-1], w, side="right") + 1.0
    return np.where((w >= 0.0) & (w < upper[-1]), number, w)


def _lightest(src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: int, tie_seed) -> np.ndarray:
    """Positions of the k lightest arcs of every ``src``; ties by a draw, if asked, then by dst."""

    def ranks(order: np.ndarray) -> np.ndarray:
        s = src[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        return np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))

    if not len(src):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((dst, w, src))
    rank = ranks(order)
    if tie_seed is None:
        return order[rank < k]
    # arcs that are no heavier than the k-th of their vertex; only they need a draw
    group = np.cumsum(rank == 0) - 1
    limit = np.full(group[-1] + 1, np.inf)
    limit[group[rank == k - 1]] = w[order[rank == k - 1]]
    some = order[w[order] <= limit[group]]
    tie = draws(tie_seed, src[some], dst[some])
    some = some[np.lexsort((dst[some], tie, w[some], src[some]))]
    return some[ranks(some) < k]


def _pairs_of(key, batches, metric):
    """(smaller id, larger id, distance) of all pairs of the group."""
    lo, hi = _pair_index(key[0].as_py())
    blocks, _ = _read_group(batches)
    if lo != hi and len(blocks) < 2:
        return None
    (ids_a, xa), (ids_b, xb) = blocks[0], blocks[-1]
    d = kernels.block_distances(xa, xb, metric)
    i, j = np.nonzero(~np.isnan(d) & ((ids_a[:, None] < ids_b[None, :]) | (lo != hi)))
    u, v = ids_a[i], ids_b[j]
    return np.minimum(u, v), np.maximum(u, v), d[i, j]


def _heaviest(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, gamma: float, seed, top: float) -> float:
    """The largest perturbed weight, ``top`` if none is larger; only weights that can be are drawn."""
    if len(w) > FAR_DRAWS:
        far = np.argpartition(w, len(w) - FAR_DRAWS)[-FAR_DRAWS:]
        top = np.maximum(top, perturbed(w[far], lo[far], hi[far], gamma, seed).max())
        may = np.flatnonzero(w * _most(gamma) >= top)
        w, lo, hi = w[may], lo[may], hi[may]
    return float(np.maximum(top, perturbed(w, lo, hi, gamma, seed).max(initial=0.0)))


def _most(gamma: float) -> float:
    """How many times a distance its perturbed weight can be at most."""
    return PERTURB_SCALE * (1.0 + abs(gamma)) * (1.0 + ROUNDING)


def _far_points(
    points: DataFrame, gamma: float, seed, metric: str, few: int = FAR_ROWS
) -> tuple[DataFrame, float]:
    """The points that can be in the heaviest perturbed pair, and a weight that some pair has.

    Points are put into cells; the driver compares the boxes of at most FAR_CELLS of them. A cell stays if
    its points can be so far from those of some cell that a draw lifts them above a weight already
    seen, and is cut into smaller ones.
    """
    dim = dimension(points)
    if metric not in grid.GRID_METRICS or dim not in FAR_DEPTH:
        return points, 0.0
    spark = points.sparkSession
    scratch = Scratch(spark, "far")
    xs, cells = grid._axes(dim)
    live = scratch.store(
        grid._coordinates(points, dim),
        **{f"min_{x}": F.min(x) for x in xs},
        **{f"max_{x}": F.max(x) for x in xs},
    )
    ends = live.metrics
    extent = max(ends[f"max_{x}"] - ends[f"min_{x}"] for x in xs) if live.rows else 0.0
    top, depth = 0.0, FAR_DEPTH[dim]
    while live.rows > few and 0.0 < extent < float("inf") and depth <= FINEST:
        side = extent / 2.0**depth
        placed = live.df.select(
            "*", *[F.floor((F.col(x) - ends[f"min_{x}"]) / side).cast("long").alias(c) for x, c in zip(xs, cells)]
        )
        boxes = placed.groupBy(*cells).agg(
            *[F.min(x).alias(f"lo_{x}") for x in xs],
            *[F.max(x).alias(f"hi_{x}") for x in xs],
            F.min(F.struct("id", *xs)).alias("one"),
        )
        table = boxes.select(*cells, *[f"{e}_{x}" for x in xs for e in ("lo", "hi")], "one.*").toArrow()
        column = {name: table.column(name).to_numpy() for name in table.column_names}
        span = np.stack(
            [
                np.maximum(u := column[f"hi_{x}"][:, None] - column[f"lo_{x}"][None, :], u.T)
                for x in xs
            ]
        )
        most = np.sqrt((span * span).sum(axis=0)) if metric == "euclidean" else span.sum(axis=0)
        one = np.stack([column[x] for x in xs], axis=1)
        i, j = np.triu_indices(len(one), 1)
        d, u, v = kernels.block_distances(one, one, metric)[i, j], column["id"][i], column["id"][j]
        far = np.flatnonzero(u != v)
        if len(far) > FAR_DRAWS:
            far = far[np.argpartition(d[far], len(far) - FAR_DRAWS)[-FAR_DRAWS:]]
        top = max(top, perturbed(d[far], np.minimum(u, v)[far], np.maximum(u, v)[far], gamma, seed).max(initial=0.0))
        stays = (most * _most(gamma) >= top).any(axis=1)
        if not stays.all():
            rows = list(zip(*[column[c][stays].tolist() for c in cells]))
            kept = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in cells))
            done, live = live, scratch.store(placed.join(F.broadcast(kept), cells).select("id", *xs))
            scratch.drop(done)
        if int(stays.sum()) << dim > FAR_CELLS:
            break
        depth += 1
    return live.df.select("id", F.array(*xs).alias("features")), float(top)


def max_perturbed_weight(
    vertices: DataFrame, gamma: float, seed, metric: str = "euclidean", block_rows: int = FAR_ROWS
) -> float:
    """The largest perturbed weight of the complete graph, 0 without pairs."""
    points, floor = _far_points(finite(vertices), gamma, seed, metric)

    def run(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = _pair_index(key[0].as_py())
        blocks, _ = _read_group(batches)
        if lo != hi and len(blocks) < 2:
            return
        (ids_a, xa), (ids_b, xb) = blocks[0], blocks[-1]
        top = floor
        for rows in kernels.row_chunks(len(ids_a), len(ids_b)):
            d = kernels.block_distances(xa[rows], xb, metric)
            far = d * _most(gamma) >= top  # not true of undefined ones
            if lo == hi:
                far &= ids_a[rows, None] < ids_b[None, :]
            i, j = np.nonzero(far)
            u, v = ids_a[rows][i], ids_b[j]
            top = _heaviest(d[i, j], np.minimum(u, v), np.maximum(u, v), gamma, seed, top)
        yield pa.RecordBatch.from_arrays([pa.array([float(top)])], names=["w"])

    tops = _block_pairs(points, block_rows).applyInArrow(run, "w double")
    value = tops.agg(F.max("w")).first()[0]
    return floor if value is None else float(value)


def _reach(worst: Column, gamma: float, bounds: list[tuple[float, float]] | None) -> Column:
    """How far a pair can be whose weight is in no later bucket than that of the distance ``worst``."""
    heavy = worst * _most(gamma)
    if bounds is not None:
        upper = F.array(*[F.lit(float(hi)) for _, hi in bounds])
        inside = F.get(upper, bucket_number(heavy, bounds) - 1)
        heavy = F.greatest(heavy, F.coalesce(inside, F.lit(float(bounds[-1][1]))))
    return heavy / (PERTURB_SCALE * (1.0 - gamma)) * (1.0 + ROUNDING)


def perturbed_nearest(
    vertices: DataFrame,
    gamma: float,
    seed,
    k: int,
    bounds: list[tuple[float, float]] | None = None,
    tie_seed=None,
    metric: str = "euclidean",
    cell_rows: int = grid.CELL_ROWS,
) -> DataFrame | None:
    """arcs that contain the k lightest of every vertex of the perturbed complete graph.

    The k nearest of a vertex are perturbed to at most (1 + gamma) times the distance of the last, so
    no arc beyond the bucket of that weight is among the k lightest, and a pair that is (1 - gamma) times
    less than farther than the bucket's end stays beyond it. Each vertex meets the points within that
    radius, in cells as large as the radius is, by powers of two. ``bounds`` have to contain all weights. None where
    this form can't tell: other metrics, more than three dimensions, or vertices with fewer than k arcs.
    """
    points = finite(vertices).where("id is not null")
    dim = dimension(points)
    if metric not in grid.GRID_METRICS or not 0 < dim <= grid.GRID_DIMENSIONS or not 0.0 <= gamma < 1.0:
        return None
    spark = points.sparkSession
    scratch = Scratch(spark, "perturbed-nearest")
    xs, axes = grid._axes(dim)
    largest = F.max(F.greatest(F.lit(0.0), *[F.abs(x) for x in xs]))
    own = scratch.store(grid._coordinates(points, dim), largest=largest)
    nearest = knn(points, k, metric, grid_rows=0).groupBy("src").agg(F.max("w").alias("worst"), F.count("*").alias("n"))
    big = own.metrics["largest"]
    finest = math.ceil(math.log2(big)) - FINEST if big else 0
    asked = scratch.store(
        own.df.join(nearest, F.col("id") == F.col("src"), "left")
        .select("id", *xs, _reach(F.col("worst"), gamma, bounds).alias("reach"), "n")
        .withColumn("lv", F.greatest(F.ceil(F.log2("reach")), F.lit(finest)).cast("long")),
        few=F.sum((F.coalesce("n", F.lit(0)) < k).cast("long")),
    )
    if asked.metrics["few"]:
        return None
    # at most one level per power of two
    levels = [(r["lv"], 2.0 ** r["lv"]) for r in asked.df.select("lv").distinct().collect()]
    sides = F.broadcast(spark.createDataFrame(levels, "lv long, side double"))

    def celled(df: DataFrame) -> DataFrame:
        return df.select("*", *[F.floor(F.col(x) / F.col("side")).cast("long").alias(c) for x, c in zip(xs, axes)]).drop("side")

    cells = ["lv", *axes]
    located = celled(own.df.crossJoin(sides))
    crowded = grid._crowded(located, own.rows * len(levels), cells, cell_rows)
    around = [(0, *o) for o in itertools.product((-1, 0, 1), repeat=dim)]
    asking = grid._looking(celled(asked.df.drop("n").join(sides, "lv")), crowded, cells, around)
    keys = [*cells, "_salt"]
    near = (
        grid._renamed(asking, keys, "a", xs, "reach")
        .join(grid._renamed(grid._dealt(located, crowded, cells), keys, "b", xs), keys)
        .where(F.col("a") != F.col("b"))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), grid._pair_distance(xs, metric).alias("w"), "reach")
        .where(F.col("w") <= F.col("reach"))
        .select("src", "dst", "w")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def lightest():
            src, dst, w = (np.concatenate([c[i] for c in waiting]) for i in range(3))
            w = perturbed(w, np.minimum(src, dst), np.maximum(src, dst), gamma, seed)
            if bounds is not None:
                w = numbered(w, bounds)
            take = _lightest(src, dst, w, k, tie_seed)
            return pa.RecordBatch.from_arrays([pa.array(c[take]) for c in (src, dst, w)], names=["src", "dst", "w"])

        for batch in batches:
            waiting.append([batch.column(i).to_numpy() for i in range(3)])
            held += batch.num_rows
            if held >= CHUNK_PAIRS:
                yield lightest()
                waiting, held = [], 0
        if held:
            yield lightest()

    return near.mapInArrow(run, "src long, dst long, w double")


def perturbed_graph(
    vertices: DataFrame,
    gamma: float,
    seeds: list,
    k: int | None = None,
    bounds: list[tuple[float, float]] | None = None,
    tie_seed=None,
    metric: str = "euclidean",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(run, src, dst, w): for the n-th of ``seeds``, run n of the perturbed complete graph.

    Without ``k``, edges that contain every run's minimum spanning forest and so all
    best-neighbour choices; with it, arcs that contain the k lightest of every vertex.
    """

    def run(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _pairs_of(key, batches, metric)
        if found is None:
            return
        lo, hi, base = found
        for n, seed in enumerate(seeds):
            w = perturbed(base, lo, hi, gamma, seed)
            if bounds is not None:
                w = numbered(w, bounds)
            if k is None:
                src, dst = lo, hi
                take = np.flatnonzero(kernels.forest_mask(lo, hi, w))
            else:
                src, dst, w = np.r_[lo, hi], np.r_[hi, lo], np.r_[w, w]
                take = _lightest(src, dst, w, k, tie_seed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(take), n, dtype=np.int32)),
                    *(pa.array(c[take]) for c in (src, dst, w)),
                ],
                names=["run", "src", "dst", "w"],
            )

    blocks = _block_pairs(finite(vertices), block_rows)
    return blocks.applyInArrow(run, "run int, src long, dst long, w double")


def _bounded_tree(
    scratch: Scratch, places: DataFrame, rows: int, tree: DataFrame, gamma: float, seeds: list, limits: Limits
) -> Stored:
    """(src, dst, most): the edges of ``tree`` between places; no run needs more than ``most`` to step from one to the other.

    Any pair of their copies is such a step, so it is the lightest of a few pairs, in the run where that is heaviest.
    """
    links = scratch.store(tree.where("w > 0").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w"))
    told = links.df
    for end in ("src", "dst"):
        told = lookup(told, links.rows, end, places, rows, {"some": f"{end}_some"}, limits)
    lists = [F.coalesce(f"{end}_some", F.array(end)).alias(f"{end}_some") for end in ("src", "dst")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = np.zeros(batch.num_rows)
            for at, lo, hi, w, first in _expanded(batch.column(3), batch.column(4), batch.column(2).to_numpy()):
                for seed in seeds:
                    lightest = np.minimum.reduceat(perturbed(w, lo, hi, gamma, seed), first)
                    most[at] = np.maximum(most[at], lightest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(most / PERTURB_SCALE)], names=["src", "dst", "most"])

    parts = told.sparkSession.sparkContext.defaultParallelism
    spread = told.select("src", "dst", "w", *lists).repartition(parts, "src", "dst")
    return scratch.store(spread.mapInArrow(run, "src long, dst long, most double"))


def _expanded(a: pa.Array, b: pa.Array, w: np.ndarray):
    """(rows, smaller id, larger id, weight, place where a row begins) of all pairs of the two lists of a row, in pieces."""
    starts, ids = [x.offsets.to_numpy() for x in (a, b)], [x.values.to_numpy() for x in (a, b)]
    size_a, size_b = (np.diff(x).astype(np.int64) for x in starts)
    held = np.cumsum(size_a * size_b)
    at = 0
    while at < len(w):
        end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + CHUNK_PAIRS, "right")))
        rows = np.arange(at, end)
        count = size_a[rows] * size_b[rows]
        row = np.repeat(rows, count)
        first = np.cumsum(count) - count
        place = np.arange(len(row)) - np.repeat(first, count)
        u, v = ids[0][starts[0][row] + place // size_b[row]], ids[1][starts[1][row] + place % size_b[row]]
        yield rows, np.minimum(u, v), np.maximum(u, v), w[row], first
        at = end


def _clusters_of_levels(
    scratch: Scratch, places: DataFrame, tree: Stored, longest: float, limits: Limits
) -> tuple[DataFrame, list[float]]:
    """(id, l0, l1, ...): the cluster of every place that the edges up to some length make, from long to short."""
    if tree.rows > limits.finish_edges:
        labels, levels = places.select("id"), [longest * share for share in LEVELS]
        for i, level in enumerate(levels):
            comps = connected_components(tree.df.where(F.col("most") <= level), places.select("id"), limits)
            labels = labels.join(comps.select("id", F.col("comp").alias(f"l{i}")), "id")
        return labels, levels
    levels = [longest * share for share in FINE_LEVELS]
    names = [f"l{i}" for i in range(len(levels))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not cols:
            return
        src, dst, most = (np.concatenate(c) for c in zip(*cols))
        ids = np.unique(np.r_[src, dst])
        labels = []
        for level in levels:
            near = most <= level
            some, lowest = kernels.component_labels(src[near], dst[near])
            label = ids.copy()
            label[np.searchsorted(ids, some)] = lowest
            labels.append(pa.array(label))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *labels], names=["id", *names])

    told = scratch.store(tree.df.coalesce(1).mapInArrow(run, ", ".join(f"{c} long" for c in ["id", *names])), small=True)
    found = places.select("id").join(told.df, "id", "left")
    return found.select("id", *[F.coalesce(c, "id").alias(c) for c in names]), levels


def _near_by_levels(
    points: DataFrame, gamma: float, seeds: list, metric: str, dim: int, tree: DataFrame, limits: Limits
) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, w): lists of copies of two places whose pairs the forest ``tree`` doesn't keep out of a perturbed one;
    and (src, dst): the links of copies, which weigh nothing in any run.

    Two points of a cluster that steps up to some length make are connected by no longer ones in all runs, so their
    pair matters only if a draw can make it that light.
    """
    scratch = Scratch(points.sparkSession, "levels")
    xs, axes = grid._axes(dim)
    own = scratch.store(grid._coordinates(points, dim).distinct())
    lists = own.df.groupBy(*xs, F.expr(f"pmod(xxhash64(id), {HASHED})").alias("_hash")).agg(
        F.array_sort(F.collect_list("id")).alias("ids")
    )
    lists = scratch.store(lists)
    places = scratch.store(
        lists.df.groupBy(*xs).agg(
            F.min(F.col("ids")[0]).alias("id"),
            F.sum(F.size("ids")).alias("n"),
            F.slice(F.flatten(F.collect_list(F.slice("ids", 1, BOUND_COPIES))), 1, BOUND_COPIES).alias("some"),
        )
    )
    # a place is known by its smallest id
    narrow = Limits(limits.broadcast_rows // BOUND_COPIES, limits.pointer_rows, limits.finish_edges, limits.heavy_share)
    bounds = _bounded_tree(scratch, places.df, places.rows, tree, gamma, seeds, narrow)
    longest = bounds.df.agg(F.max("most")).first()[0]
    zero = None
    if places.rows < own.rows:
        by_place = places.df.where("n > 1").select(*xs, F.col("id").alias("src"))
        zero = own.df.join(by_place, xs).where(F.col("id") != F.col("src")).select("src", F.col("id").alias("dst"))
    labels, levels = _clusters_of_levels(scratch, places.df, bounds, longest or 0.0, limits)
    names = [f"l{i}" for i in range(len(levels))]
    stretch = (1.0 + ROUNDING) / (1.0 - gamma)
    reach = (longest or 1.0) * stretch
    cut = F.transform(F.sequence(F.lit(0), F.size("ids") - 1, F.lit(LISTED)), lambda i: F.slice("ids", i + 1, LISTED))
    placed = places.df.select("id", *xs).join(labels, "id")
    units = lists.df.join(placed, xs).select("id", *xs, *names, F.explode(cut).alias("ids"))
    cells = [F.floor(F.col(x) / (reach * (1.0 + ROUNDING))).cast("long").alias(c) for x, c in zip(xs, axes)]
    units = scratch.store(units.select("*", *cells))
    crowded = grid._crowded(units.df, units.rows, axes, grid.CELL_ROWS)
    half = [o for o in itertools.product((-1, 0, 1), repeat=dim) if o >= (0,) * dim]
    keys = [*axes, "_salt"]
    # few bytes can be many pairs
    parts = min(max(4 * points.sparkSession.sparkContext.defaultParallelism, units.rows // TASK_ROWS), MAX_TASKS)

    def side(df: DataFrame, prefix: str, *more: str) -> DataFrame:
        named = [F.col(c).alias(prefix + c) for c in ["id", *xs, *names, "ids"]]
        return df.select(*keys, *more, *named).repartition(parts, *keys)

    most = F.lit(reach)
    for name, level in zip(names, levels):
        same = F.col(f"a{name}") == F.col(f"b{name}")
        most = F.when(same, F.lit(level * stretch)).otherwise(most)
    near = (
        side(grid._dealt(units.df, crowded, axes), "a")
        .join(side(grid._looking(units.df, crowded, axes, half), "b", "_own"), keys)
        .where(F.when(F.col("_own"), F.col("aid") < F.col("bid")).otherwise(F.col("aid") != F.col("bid")))
        .withColumn("w", grid._pair_distance(xs, metric))
        .where((F.col("w") <= reach) & (F.col("w") <= most))
        .select(F.col("aids").alias("a"), F.col("bids").alias("b"), "w")
    )
    return near, zero


def perturbed_forests(
    vertices: DataFrame,
    gamma: float,
    seeds: list,
    longest: float,
    metric: str = "euclidean",
    tree: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """(run, src, dst, w): edges that contain every run's minimum spanning forest of the perturbed complete graph.

    ``longest`` is the longest edge of the unperturbed forest. No path of that forest gets heavier than
    (1 + gamma) * longest, and a pair that is farther than (1 + gamma) / (1 - gamma) * longest stays
    heavier than that, so it closes a cycle as its heaviest edge. Only nearer pairs are met; a
    task draws their weights for every run and keeps one forest a run. With the forest itself (``tree``) shorter
    paths keep out more in few dimensions (``_near_by_levels``).
    """
    points = finite(vertices).where("id is not null")
    dim = dimension(points) if tree is not None and metric in grid.GRID_METRICS else 0
    if 0 < dim <= grid.GRID_DIMENSIONS:
        seen = grid._coordinates(points, dim).distinct().agg(F.count(F.lit(1)), F.count_distinct("id")).first()
        dim = dim if seen[0] == seen[1] else 0  # an id at two places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.array([], np.int64), np.array([], np.int64), np.array([])]
        kept, waiting, held = [none] * len(seeds), [[] for _ in seeds], 0

        def out(n):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(kept[n][0]), n, dtype=np.int32)), *(pa.array(c) for c in kept[n])],
                names=["run", "src", "dst", "w"],
            )

        def squeeze():
            for n in range(len(seeds)):
                cols = [np.concatenate(c) for c in zip(kept[n], *waiting[n])]
                mask = kernels.forest_mask(*cols)
                kept[n], waiting[n] = [c[mask] for c in cols], []

        for batch in batches:
            for _, lo, hi, w, first in _expanded(batch.column(0), batch.column(1), batch.column(2).to_numpy()):
                for n, seed in enumerate(seeds):
                    waiting[n].append(_lightest_of_rows(lo, hi, perturbed(w, lo, hi, gamma, seed), first))
                held += len(first)
                if held >= max(CHUNK_PAIRS, len(kept[0][0])):
                    squeeze()
                    held = 0
                    if sum(len(k[0]) for k in kept) > HELD_EDGES:
                        for n in range(len(seeds)):
                            yield out(n)
                        kept = [none] * len(seeds)
        if held:
            squeeze()
        for n in range(len(seeds)):
            yield out(n)

    kind = "run int, src long, dst long, w double"
    if not 0 < dim <= grid.GRID_DIMENSIONS:
        near = eps_join(vertices, longest * (1.0 + gamma) / (1.0 - gamma) * (1.0 + ROUNDING), metric)
        return near.select(F.array("src").alias("a"), F.array("dst").alias("b"), "w").mapInArrow(run, kind)
    near, zero = _near_by_levels(points, gamma, seeds, metric, dim, tree, limits)
    drawn = near.mapInArrow(run, kind)
    if zero is None:
        return drawn
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(seeds) - 1))).alias("run")
    return drawn.unionByName(zero.select(numbers, "src", "dst", F.lit(0.0).alias("w")))


def _lightest_of_rows(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lightest pair of every row, ties by id: copies are linked by edges that weigh nothing, so no other is in a forest."""
    if len(first) == len(w):
        return lo, hi, w
    row = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(w)]))
    best = np.flatnonzero(w == np.minimum.reduceat(w, first)[row])
    best = best[np.lexsort((hi[best], lo[best], row[best]))]
    best = best[kernels.places_in_groups(row[best]) == 0]
    return lo[best], hi[best], w[best]
