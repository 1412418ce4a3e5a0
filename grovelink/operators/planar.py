"""Minimum spanning trees of points in two and three dimensions without all distances.

Points are put in order along a space-filling curve and cut into blocks of bounded size. A
block gets its own spanning tree; a tree edge much longer than the usual one of its
block cuts it into fragments, so a far point doesn't stretch the others' box. Fragments
are linked to near ones by distances of sample points, and the spanning tree of these links
gives, for any two fragments, a bound: every two of their points are connected by steps no
longer than that. By the cycle property a longer edge between them is not in the answer. So
two fragments meet only if their boxes are within their bound, and then only with the
points that are that near to the other's box. Such pairs of fragments are found from the
boxes of runs of fragments down to single ones: two runs that are farther apart than the largest
bound between them are left at once.

Points may have a core distance, and no edge is lighter than that of either end (mutual
reachability); all the above holds for these weights.

A task holds one block, or the facing points of two fragments. What is gathered and
broadcast is one row per fragment; blocks grow with the table, so that there are MOST_FRAGMENTS
at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import assign_ids
from ..scratch import Scratch, Stored
from . import kernels
from .pairs import knn

BLOCK_ROWS = 512
MOST_FRAGMENTS = 400_000
CURVE_BITS = {2: 30, 3: 20}
NEAR = 6  # fragments that each fragment is linked to
SAMPLES = 64  # points that stand for a fragment when it is linked
CUTS = 15  # edges that cut a block, at most, each more than LONG usual ones
LONG = 4.0
LINKS_AGAIN = 8  # fragments of a run that are linked again under a bound
RUNS = 2048  # runs of fragments that are met one by one, before they are halved
CHUNK_PAIRS = 500_000  # pairs of points that are measured at once
HELD_EDGES = 1_000_000  # edges between fragments that a task reads before it squeezes them
ROUNDING = 1e-9


def curve_position(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (row, axis) below 2 ** ``bits``.

    From the highest bit down, the lower bits of the axes are reflected or exchanged so that
    each sub-cube is passed through in the orientation that joins its neighbours.
    """
    x = cells.astype(np.int64)
    axes = x.shape[1]
    for b in range(bits - 1, 0, -1):
        lower = (1 << b) - 1
        for i in range(axes):
            inside = (x[:, i] >> b) & 1 == 1
            swap = np.where(inside, 0, (x[:, 0] ^ x[:, i]) & lower)
            x[:, 0] ^= np.where(inside, lower, 0) ^ swap
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip[:, None]
    out = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def _in_blocks(scratch: Scratch, points: DataFrame, dim: int, rows: int, block_rows: int) -> Stored:
    """(id, features, core, block): runs of at most ``block_rows`` points along the curve."""
    coordinates = [F.col("features")[i] for i in range(dim)]
    ends = points.agg(*[f(c) for c in coordinates for f in (F.min, F.max)]).first()
    low, high = np.array(ends[0::2]), np.array(ends[1::2])
    bits = CURVE_BITS[dim]
    # halves, since a difference of large numbers may be infinite
    extent = float((high / 2 - low / 2).max()) or 1.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = kernels.vectors(batch.column(1))
            share = (x / 2 - low / 2) / extent
            cells = np.clip(share * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            position = pa.array(curve_position(cells, bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, position], names=["id", "features", "core", "curve"])

    placed = scratch.store(
        points.mapInArrow(place, "id long, features array<double>, core double, curve long")
    ).df
    ordered = assign_ids(placed, "curve", "id", id_col="at")
    return scratch.store(ordered.select("id", "features", "core", F.floor(F.col("at") / block_rows).alias("block"), "at"))


_LOCAL = (
    "kind string, fragment long, src long, dst long, w double, "
    "features array<double>, core double, low array<double>, high array<double>"
)


def _local_trees(points: DataFrame, metric: str) -> DataFrame:
    """Rows of four kinds: 'edge' (src, dst, w) of the blocks' trees, 'link' (src, dst, w) between
    fragments of one block, 'point' (fragment, src, features, core), and 'box' of a fragment:
    w its longest edge, features its flattened sample with cores, core the smallest one."""

    def run(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("at")
        ids, x = table.column("id").to_numpy(), kernels.vectors(table.column("features"))
        core = table.column("core").to_numpy()
        src, dst, w = kernels.dense_forest(ids, x, None, metric, core)
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids, e, sorter=order)] for e in (src, dst))
        cut = np.zeros(len(w), dtype=bool)
        if len(w):
            longest = np.argsort(w, kind="stable")[::-1][:CUTS]
            cut[longest] = w[longest] > LONG * np.median(w)
        label = np.arange(len(ids))
        while True:  # labels of what the edges that aren't cut connect
            low = np.minimum(label[a[~cut]], label[b[~cut]])
            new = label.copy()
            np.minimum.at(new, a[~cut], low)
            np.minimum.at(new, b[~cut], low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        names, own = np.unique(label, return_inverse=True)
        first = key[0].as_py() * (CUTS + 1)  # fragments are numbered block by block
        boxes = []
        for f in range(len(names)):
            rows = np.flatnonzero(own == f)
            inside = ~cut & (own[a] == f)
            some = rows[:: -(-len(rows) // SAMPLES)]
            sample = np.column_stack([x[some], core[some]]).ravel().tolist()
            longest = float(w[inside].max()) if inside.any() else 0.0
            box = x[rows].min(axis=0).tolist(), x[rows].max(axis=0).tolist()
            boxes.append((longest, sample, float(core[rows].min()), *box))
        n, e, c, f = len(ids), len(w), int(cut.sum()), len(names)
        none = [None]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["edge"] * e + ["link"] * c + ["point"] * n + ["box"] * f),
                pa.array(none * (e + c) + (own + first).tolist() + list(range(first, first + f)), pa.int64()),
                pa.array(src.tolist() + (own[a[cut]] + first).tolist() + ids.tolist() + none * f, pa.int64()),
                pa.array(dst.tolist() + (own[b[cut]] + first).tolist() + none * (n + f), pa.int64()),
                pa.array(w.tolist() + w[cut].tolist() + none * n + [v[0] for v in boxes], pa.float64()),
                pa.array(none * (e + c) + x.tolist() + [v[1] for v in boxes], pa.list_(pa.float64())),
                pa.array(none * (e + c) + core.tolist() + [v[2] for v in boxes], pa.float64()),
                pa.array(none * (e + c + n) + [v[3] for v in boxes], pa.list_(pa.float64())),
                pa.array(none * (e + c + n) + [v[4] for v in boxes], pa.list_(pa.float64())),
            ],
            names=["kind", "fragment", "src", "dst", "w", "features", "core", "low", "high"],
        )

    blocks = points.select("block", "at", "id", "features", "core").groupBy("block")
    return blocks.applyInArrow(run, _LOCAL)


def _links(boxes: DataFrame, inner: DataFrame, metric: str) -> DataFrame:
    """(src, dst, w): fragments with a distance between two of their points."""
    middle = F.transform(F.arrays_zip("low", "high"), lambda p: p["low"] / 2 + p["high"] / 2)
    near = knn(boxes.select(F.col("fragment").alias("id"), middle.alias("features")), NEAR, metric)
    # the next block's first fragment, so that all are connected
    each = CUTS + 1
    step = F.floor(F.col("fragment") / each) * each
    chain = boxes.where(F.col("fragment") == step).select(
        (F.col("fragment") - each).alias("src"), F.col("fragment").alias("dst")
    )
    pairs = near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return _measured(pairs.unionByName(chain).distinct(), boxes, metric).unionByName(inner)


def _measured(pairs: DataFrame, boxes: DataFrame, metric: str) -> DataFrame:
    """(src, dst, w): the smallest distance of two fragments' sample points."""
    sample = boxes.select("fragment", "features")
    met = pairs.join(sample.toDF("src", "a"), "src").join(sample.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
    width = boxes.select(F.size("low")).first()[0]

    def nearest(a: list[float], b: list[float]) -> float:
        a, b = (np.array(v).reshape(-1, width + 1) for v in (a, b))
        d = kernels.block_distances(a[:, :width], b[:, :width], metric)
        return float(np.maximum(np.maximum(d, a[:, width:]), b[None, :, width]).min())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [nearest(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w)], names=["src", "dst", "w"])

    return met.mapInArrow(run, "src long, dst long, w double")


def _bounds(fragments: np.ndarray, longest: np.ndarray, links: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The fragments in an order in which the bound of two is the largest height between them.

    Kruskal's rounds over the links join two runs of fragments end to end, and the gap gets
    the weight under which they were joined.
    """
    at = {f: i for i, f in enumerate(fragments.tolist())}
    src = np.array([at[f] for f in links.column("src").to_pylist()], dtype=np.int64)
    dst = np.array([at[f] for f in links.column("dst").to_pylist()], dtype=np.int64)
    w = np.maximum(links.column("w").to_numpy(), np.maximum(longest[src], longest[dst]))
    keep = kernels.forest_mask(src, dst, w)
    src, dst, w = src[keep], dst[keep], w[keep]
    parent, tail = list(range(len(at))), list(range(len(at)))
    after, gap = [-1] * len(at), [math.inf] * len(at)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n in np.argsort(w, kind="stable").tolist():
        a, b = root(int(src[n])), root(int(dst[n]))
        # the head of a run is its root
        after[tail[a]], gap[tail[a]] = b, float(w[n])
        tail[a], parent[b] = tail[b], a
    order, here = [], root(0)
    while here >= 0:
        order.append(here)
        here = after[here]
    return np.array(order), np.array([gap[i] for i in order])


def box_distance(low_a, high_a, low_b, high_b, metric: str) -> np.ndarray:
    """The smallest distance that points of two boxes can have, less what rounding may add."""
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0.0)
    away = np.sqrt((gap * gap).sum(axis=-1)) if metric == "euclidean" else gap.sum(axis=-1)
    return away * (1.0 - ROUNDING)


def _halved(values: np.ndarray, smallest: bool) -> list[np.ndarray]:
    """Smallest or largest values of single rows, of runs of 2, of 4, and so on."""
    levels = [values]
    while len(levels[-1]) > 1:
        two = levels[-1].reshape(-1, 2, *values.shape[1:])
        levels.append(two.min(axis=1) if smallest else two.max(axis=1))
    return levels


def near_boxes(
    low: np.ndarray, high: np.ndarray, core: np.ndarray, place: np.ndarray, gap: np.ndarray, metric: str
):
    """(number of runs, function): for a run of boxes, (i, j, bound, distance), i < j, of those within their bound.

    Box i stands at ``place[i]`` of the order whose gaps are ``gap``. Boxes near to each other should follow
    each other, so that the box of a run is small.
    """
    n = len(place)
    size = 1 << max(0, (n - 1).bit_length())

    def padded(values, fill):
        return np.concatenate([values, np.full((size - n, *values.shape[1:]), fill, dtype=values.dtype)])

    lows, highs = _halved(padded(low, np.inf), True), _halved(padded(high, -np.inf), False)
    cores = _halved(padded(core, np.inf), True)
    firsts, lasts = _halved(padded(place, n), True), _halved(padded(place, -1), False)
    # largest gap of every 1, 2, 4, ... that follow each other
    spans = [gap[: n - 1]]
    while 2 << (len(spans) - 1) <= n - 1:
        half = 1 << (len(spans) - 1)
        spans.append(np.maximum(spans[-1][:-half], spans[-1][half:]))

    def bounds(level, u, v):
        first = np.minimum(firsts[level][u], firsts[level][v])
        last = np.maximum(lasts[level][u], lasts[level][v])
        length = last - first
        out = np.full(len(u), np.inf)
        power = np.frexp(np.maximum(length, 1))[1] - 1
        for k in np.unique(power):
            at = np.flatnonzero((power == k) & (length > 0))
            out[at] = np.maximum(spans[k][first[at]], spans[k][last[at] - (1 << k)])
        return out

    def near(level, u, v):
        there = (lasts[level][u] >= 0) & (lasts[level][v] >= 0)
        u, v = u[there], v[there]
        bound = bounds(level, u, v)
        away = box_distance(lows[level][u], highs[level][u], lows[level][v], highs[level][v], metric)
        away = np.maximum(away, np.maximum(cores[level][u], cores[level][v]))
        met = (u == v) | (away <= bound)
        return u[met], v[met], bound[met], away[met]

    top = max(0, len(lows) - 1 - (RUNS - 1).bit_length())

    def run(number: int):
        others = np.arange(number, len(lows[top]))
        u, v, bound, away = near(top, np.full(len(others), number), others)
        for level in range(top - 1, -1, -1):
            pairs = [(2 * u + i, 2 * v + j) for i in (0, 1) for j in (0, 1)]
            u, v = (np.concatenate([p[side] for p in pairs]) for side in (0, 1))
            once = u <= v
            u, v, bound, away = near(level, u[once], v[once])
        other = u != v
        return u[other], v[other], bound[other], away[other]

    return len(lows[top]), run


def _near_pairs(
    scratch: Scratch,
    fragments: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    core: np.ndarray,
    place: np.ndarray,
    gap: np.ndarray,
    metric: str,
    nearest: int | None = None,
) -> Stored:
    """(a, b, bound) of the fragments whose boxes are within their bound.

    With ``nearest`` only so many of a run of fragments that have the same bound.
    """
    spark = scratch.spark
    runs, _ = near_boxes(low, high, core, place, gap, metric)
    parts = max(1, min(runs // 16, spark.sparkContext.defaultParallelism * 4))
    # a run meets those after it, so the work falls from first to last
    shuffled = spark.range(runs).select(F.xxhash64("id").alias("_mix"), "id").repartition(parts, "_mix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, near = near_boxes(low, high, core, place, gap, metric)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                i, j, bound, away = near(number)
                if nearest is not None:
                    some = np.lexsort((j, i, away, bound))
                    some = some[kernels.places_in_groups(bound[some]) < nearest]
                    i, j, bound = i[some], j[some], bound[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fragments[i]), pa.array(fragments[j]), pa.array(bound)], names=["a", "b", "bound"]
                )

    return scratch.store(shuffled.select("id").mapInArrow(run, "a long, b long, bound double"))


def _facing(points: DataFrame, boxes: DataFrame, pairs: DataFrame, dim: int, metric: str) -> DataFrame:
    """(a, b, bound, second, id, features, core): the points of a pair that are near to the other's box."""
    sides = F.array(
        F.struct(F.col("a").alias("fragment"), F.col("b").alias("other"), F.lit(False).alias("second")),
        F.struct(F.col("b").alias("fragment"), F.col("a").alias("other"), F.lit(True).alias("second")),
    )
    looks = pairs.select("a", "b", "bound", F.explode(sides).alias("_s")).select("a", "b", "bound", "_s.*")
    other = boxes.select(F.col("fragment").alias("other"), "low", "high")
    looks = looks.join(other, "other").select("fragment", "a", "b", "second", "bound", "low", "high")
    gaps = [
        F.greatest(F.col("low")[i] - F.col("features")[i], F.col("features")[i] - F.col("high")[i], F.lit(0.0))
        for i in range(dim)
    ]
    terms = [g * g for g in gaps] if metric == "euclidean" else gaps
    total = sum(terms[1:], terms[0])
    away = F.sqrt(total) if metric == "euclidean" else total
    return (
        points.join(looks, "fragment")
        .where(F.greatest(away * (1.0 - ROUNDING), F.col("core")) <= F.col("bound"))
        .select("a", "b", "bound", "second", "id", "features", "core")
    )


def _between(table: pa.Table, metric: str) -> tuple[np.ndarray, ...]:
    """(src, dst, w) of the pairs of points within their bound, across whole pairs of fragments.

    A pair of fragments with more than CHUNK_PAIRS gives only its forest.
    """
    a, b, second = (table.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "second"))
    ids, core, bound = (table.column(c).to_numpy() for c in ("id", "core", "bound"))
    x = kernels.vectors(table.column("features"))
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    end = np.r_[start[1:], len(a)]
    here = np.add.reduceat((~second).astype(np.int64), start)
    there = end - start - here
    many = here * there
    out = []
    for g in np.flatnonzero(many > CHUNK_PAIRS):
        rows = slice(start[g], end[g])
        out.append(kernels.dense_forest(ids[rows], x[rows], second[rows], metric, core[rows]))
    columns = np.ascontiguousarray(x.T)
    rest = np.flatnonzero((many > 0) & (many <= CHUNK_PAIRS))
    ends = np.cumsum(many[rest])
    done = 0
    while done < len(rest):
        before = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, before + CHUNK_PAIRS, side="right")))
        groups, done = rest[done:upto], upto
        owner = np.repeat(groups, many[groups])
        number = np.arange(len(owner)) - np.repeat(np.cumsum(many[groups]) - many[groups], many[groups])
        i = start[owner] + number // there[owner]
        j = start[owner] + here[owner] + number % there[owner]
        w = kernels.pair_distances(columns, columns, i, j, metric)
        w = np.maximum(np.maximum(w, core[i]), core[j])
        near = w <= bound[i]
        u, v = ids[i[near]], ids[j[near]]
        out.append((np.minimum(u, v), np.maximum(u, v), w[near]))
    none = (np.array([], np.int64), np.array([], np.int64), np.array([]))
    return tuple(np.concatenate(c) for c in zip(none, *out))


def _across(facing: DataFrame, parts: int, metric: str) -> DataFrame:
    """(src, dst, w): edges between fragments; a task squeezes those it has to their forest."""
    dealt = facing.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "second", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.array([], np.int64), np.array([], np.int64), np.array([])]
        waiting, held, rest, rows = [], 0, [], 0

        def squeeze():
            cols = [np.concatenate(c) for c in zip(kept, *waiting)]
            mask = kernels.forest_mask(*cols)
            return [c[mask] for c in cols]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=["src", "dst", "w"])

        def whole(last: bool):
            """The whole pairs of fragments of what was read, and the rows of the one that may go on."""
            table = pa.Table.from_batches(rest)
            if last:
                return table, []
            a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
            other = np.flatnonzero((a != a[-1]) | (b != b[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            return table.slice(0, cut), table.slice(cut).to_batches()

        batches, last = iter(batches), False
        while not last:
            batch = next(batches, None)
            last = batch is None
            if not last:
                if batch.num_rows:
                    rest.append(batch)
                    rows += batch.num_rows
                if rows < 20_000:
                    continue
            if not rest:
                break
            table, rest = whole(last)
            # what goes on is looked at again when as much has come
            rows = 0
            if table.num_rows:
                waiting.append(_between(table, metric))
                held += len(waiting[-1][0])
            if held >= max(HELD_EDGES, len(kept[0])):
                kept, waiting, held = squeeze(), [], 0
                if len(kept[0]) > HELD_EDGES:
                    yield out()
                    kept = [c[:0] for c in kept]
        kept = squeeze()
        yield out()

    return dealt.mapInArrow(run, "src long, dst long, w double")


def planar_candidates(
    points: DataFrame, metric: str, dim: int, rows: int, block_rows: int = BLOCK_ROWS, longest: float = math.inf
) -> tuple[DataFrame, dict]:
    """Edges that contain the minimum spanning tree of the complete graph, each pair once.

    ``points`` are finite; with a column ``core`` the weights are those of mutual reachability. No edge of
    the tree above ``longest`` need be there. Also the numbers of fragments, pairs of fragments and distances.
    """
    scratch = Scratch(points.sparkSession, "planar")
    # a block has CUTS + 1 fragments at most
    block_rows = max(block_rows, -(-rows * (CUTS + 1) // MOST_FRAGMENTS))
    core = F.col("core").cast("double") if "core" in points.columns else F.lit(0.0)
    plain = points.select(
        F.col("id").cast("long").alias("id"),
        F.transform("features", lambda v: v.cast("double")).alias("features"),
        core.alias("core"),
    )
    blocks = _in_blocks(scratch, plain, dim, rows, block_rows)
    local = scratch.store(
        _local_trees(blocks.df, metric),
        fragments=F.sum((F.col("kind") == "box").cast("long")),
    )
    scratch.drop(blocks)
    count = local.metrics["fragments"] or 0
    trees = local.df.where("kind = 'edge'").select("src", "dst", "w")
    told = {"fragments": count, "pairs": 0, "distances": rows * block_rows}
    if count < 2:
        return trees, told
    boxes = local.df.where("kind = 'box'").select("fragment", "w", "features", "core", "low", "high")
    inner = local.df.where("kind = 'link'").select("src", "dst", "w")
    links = scratch.store(_links(boxes, inner, metric))
    # one row per fragment, MOST_FRAGMENTS at most
    table = boxes.select("fragment", "w", "core", "low", "high").toArrow().sort_by("fragment")
    fragments, tallest = table.column("fragment").to_numpy(), table.column("w").to_numpy()
    low, high = (kernels.vectors(table.column(c)) for c in ("low", "high"))
    smallest = table.column("core").to_numpy()

    def within_bounds(links: pa.Table, nearest: int | None = None) -> Stored:
        order, gap = _bounds(fragments, tallest, links)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        gap = np.minimum(gap, longest)
        return _near_pairs(scratch, fragments, low, high, smallest, place, gap, metric, nearest)

    # groups that only a long link connects are linked again where they are near to each other
    linked = links.df.toArrow()
    again = within_bounds(linked, LINKS_AGAIN).df.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    shorter = scratch.store(_measured(again, boxes, metric))
    pairs = within_bounds(pa.concat_tables([linked, shorter.df.toArrow().cast(linked.schema)]))
    own = local.df.where("kind = 'point'").select("fragment", F.col("src").alias("id"), "features", "core")
    facing = scratch.store(_facing(own, boxes.select("fragment", "low", "high"), pairs.df, dim, metric))
    met = facing.df.groupBy("a", "b").agg(
        F.sum(F.col("second").cast("long")).alias("there"), F.count(F.lit(1)).alias("all")
    )
    there = F.col("there") * (F.col("all") - F.col("there"))
    distances = met.agg(F.sum(there)).first()[0] or 0
    told |= {"pairs": pairs.rows, "distances": told["distances"] + distances}
    cores = points.sparkSession.sparkContext.defaultParallelism
    # fewer tasks squeeze more
    parts = max(cores * 2, -(-facing.rows // HELD_EDGES))
    return scratch.store(trees.unionByName(_across(facing.df, parts, metric))).df, told
