"""Small numpy helpers that run inside Spark tasks on one bounded block of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CELL_LIMIT = 2_000_000
PIECE = 1 << 15  # pairs that are measured at once
PROBE = 2048
ROUGH_DIMENSIONS = 8  # from here on a matrix product pays


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """ARRAY<DOUBLE> column to a matrix; vectors of different length are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if n and (column.null_count or (lengths != lengths[0]).any()):
        raise ValueError("all feature vectors must have the same length")
    return flat.astype(np.float64, copy=False).reshape(n, -1 if flat.size else 0)


def block_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every row of ``a`` to every row of ``b``.

    Terms are added feature by feature, in order, so the value of a pair does
    not depend on the block it was computed in.
    """
    if a.shape[0] and b.shape[0] and a.shape[1] != b.shape[1]:
        raise ValueError("all feature vectors must have the same length")
    out = np.zeros((a.shape[0], b.shape[0]))
    for k in range(a.shape[1]):
        x, y = a[:, k, None], b[None, :, k]
        if metric == "euclidean":
            diff = x - y
            out += diff * diff
        elif metric == "manhattan":
            out += np.abs(x - y)
        else:
            out += x * y
    if metric == "euclidean":
        return np.sqrt(out, out=out)
    if metric == "cosine":
        scale = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(scale == 0.0, np.nan, 1.0 - out / scale)
    return out


def row_chunks(rows: int, columns: int):
    """Slices of a block that keep a distance matrix under CELL_LIMIT cells."""
    step = max(1, CELL_LIMIT // max(1, columns))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def pair_distances(
    a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str
) -> np.ndarray:
    """Distances of the rows ``i`` of ``a`` to the rows ``j`` of ``b``, as ``block_distances`` has them.

    ``a`` and ``b`` are given by columns (transposed).
    """
    out = np.zeros(len(i))
    for start in range(0, len(i), PIECE):
        piece = slice(start, start + PIECE)
        p, q, total = i[piece], j[piece], out[piece]
        for x, y in zip(a, b):
            if metric == "cosine":
                total += x[p] * y[q]
            else:
                diff = x[p] - y[q]
                total += diff * diff if metric == "euclidean" else np.abs(diff)
    if metric == "euclidean":
        return np.sqrt(out, out=out)
    if metric == "cosine":
        length_a, length_b = (np.sqrt((np.ascontiguousarray(m.T) ** 2).sum(axis=1)) for m in (a, b))
        scale = length_a[i] * length_b[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(scale == 0.0, np.nan, 1.0 - out / scale)
    return out


class Rough:
    """Squared Euclidean or cosine distances of two blocks by one matrix product.

    They are off by at most ``slack`` (one number per row of ``a``), so they only tell which
    pairs can be left out; those that stay are measured by ``pair_distances``.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, metric: str):
        unit = 4.0 * (a.shape[1] + 8) * np.finfo(np.float64).eps
        self.squared = metric == "euclidean"
        size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
        if self.squared:
            self.a, self.b, self.size_a, self.size_b = -2.0 * a, b.T, size_a, size_b
            self.slack = unit * (size_a + size_b.max(initial=0.0)) + 1e-300
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                self.a, self.b = -a / np.sqrt(size_a)[:, None], (b / np.sqrt(size_b)[:, None]).T
            self.slack = np.full(len(a), 4.0 * unit)

    @staticmethod
    def of(a: np.ndarray, b: np.ndarray, metric: str) -> Rough | None:
        """None where a matrix product saves nothing or could be undefined or overflow."""
        if metric == "manhattan" or a.shape[1] < ROUGH_DIMENSIONS or not (len(a) and len(b)):
            return None
        if a.shape[1] != b.shape[1]:
            raise ValueError("all feature vectors must have the same length")
        for x in (a, b):
            # a NaN is not below; lengths outside would lose digits in the squares
            if not np.abs(x).max() < 1e150:
                return None
            if metric == "cosine" and not np.all(_plain_length(x)):
                return None
        return Rough(a, b, metric)

    def rows(self, rows: slice) -> np.ndarray:
        out = self.a[rows] @ self.b
        if self.squared:
            out += self.size_a[rows, None]
            out += self.size_b[None, :]
        else:
            out += 1.0
        return out

    def limit(self, bound: np.ndarray) -> np.ndarray:
        """What ``bound`` is in the units of ``rows``, with room for rounding."""
        return bound * bound * (1.0 + 1e-12) if self.squared else bound


def _plain_length(x: np.ndarray) -> np.ndarray:
    """Rows that are zero, or neither so long nor so short that the square loses digits."""
    size = (x * x).sum(axis=1)
    return ~x.any(axis=1) | ((size > 1e-200) & (size < 1e200))


def places_in_groups(keys: np.ndarray) -> np.ndarray:
    """Place of every row, from 0, among those of the same key; equal keys follow each other."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))


def nearest_mask(d: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k smallest defined values per row, ties to the left."""
    d = np.where(np.isnan(d), np.inf, d)
    if d.shape[1] <= k:
        return np.isfinite(d)
    kth = np.partition(d, k - 1, axis=1)[:, k - 1, None]
    below, equal = d < kth, (d == kth) & np.isfinite(d)
    room = k - below.sum(axis=1, keepdims=True)
    return below | (equal & (np.cumsum(equal, axis=1) <= room))


def near_pairs(
    a: np.ndarray,
    b: np.ndarray,
    metric: str,
    bound: np.ndarray | None = None,
    k: int | None = None,
    ids: tuple[np.ndarray, np.ndarray] | None = None,
):
    """(i, j, distance) of rows of ``a`` and ``b`` within ``bound`` (one number per row of ``a``), in pieces.

    With ``k`` only the k nearest of every row, ties to the left; with ``ids`` no pair of equal ids.
    Most pairs are ruled out by a matrix product, the distances of the others are exact.
    """
    rough = Rough.of(a, b, metric)
    bound = np.full(len(a), np.inf) if bound is None else bound
    columns = None if rough is None else (np.ascontiguousarray(a.T), np.ascontiguousarray(b.T))
    for rows in row_chunks(len(a), len(b)):
        d = block_distances(a[rows], b, metric) if rough is None else rough.rows(rows)
        if ids is not None:
            d[ids[0][rows, None] == ids[1][None, :]] = np.nan
        if rough is None:
            d[~(d <= bound[rows, None])] = np.nan
            i, j = np.nonzero(~np.isnan(d) if k is None else nearest_mask(d, k))
            yield i + rows.start, j, d[i, j]
            continue
        limit, slack = rough.limit(bound[rows]), rough.slack[rows]
        if k is not None:
            # some columns tell how far the k nearest can be at most
            some = d[:, :: max(1, d.shape[1] // max(PROBE, 4 * k))]
            if some.shape[1] > k:
                kth = np.partition(some, k - 1, axis=1)[:, k - 1]
                limit = np.fmin(limit, kth + slack)
        # far faster than nonzero in two dimensions
        i, j = np.divmod(np.flatnonzero(d <= (limit + slack)[:, None]), d.shape[1])
        i += rows.start
        w = pair_distances(*columns, i, j, metric)
        if k is None:
            good = w <= bound[i]
        else:
            good = np.flatnonzero(w <= bound[i])
            good = good[np.lexsort((w[good], i[good]))]  # by row and distance, ties stay by column
            good = good[places_in_groups(i[good]) < k]
        yield i[good], j[good], w[good]


def _nearest_outside(best_w, best_lo, best_hi):
    """Position of the smallest (w, lo, hi)."""
    low = best_w.min()
    ties = np.flatnonzero(best_w == low)
    if len(ties) == 1:
        return ties[0]
    return ties[np.lexsort((best_hi[ties], best_lo[ties]))[0]]


def dense_forest(
    ids: np.ndarray, x: np.ndarray, side: np.ndarray | None, metric: str, core: np.ndarray | None = None
):
    """Minimum spanning tree of a complete (or, with ``side``, bipartite) block.

    Grows one tree and keeps, for every vertex outside it, the lightest link
    into it, so only one row of distances exists at a time. Ties follow the
    total order (w, smaller id, larger id). Undefined distances are no edges.
    With many coordinates a product tells which vertices can have come nearer; only
    those are measured. With ``core`` no link is lighter than the number of either end.
    """
    n = len(ids)
    big = np.iinfo(np.int64).max
    best_w, best_lo, best_hi = np.full(n, np.inf), np.full(n, big), np.full(n, big)
    outside, src, dst, weight = np.ones(n, dtype=bool), [], [], []
    rough = Rough.of(x, x, metric) if metric == "euclidean" and core is None else None
    if rough is not None:
        # the vertices that a side can be linked with, and up to where they can come nearer
        others = {s: np.flatnonzero(side != s) if side is not None else np.arange(n) for s in (np.unique(side) if side is not None else [None])}
        there = {s: np.ascontiguousarray(x[at]) for s, at in others.items()}
        nearer = np.full(n, np.inf)
    v = 0
    for _ in range(n):
        outside[v] = False
        if rough is None:
            at = slice(None)
            reach = outside if side is None else outside & (side != side[v])
            d = block_distances(x[v : v + 1], x, metric)[0]
            if core is not None:
                d = np.maximum(np.maximum(d, core), core[v])
        else:
            nearer[v] = -np.inf
            s = None if side is None else side[v]
            at = others[s]
            product = there[s] @ rough.a[v]
            product += rough.size_b[at]
            at = at[product <= nearer[at] + (rough.slack[v] - rough.size_a[v])]
            reach = outside[at]
            d = block_distances(x[v : v + 1], x[at], metric)[0]
        reach = reach & ~np.isnan(d)
        lo, hi = np.minimum(ids[at], ids[v]), np.maximum(ids[at], ids[v])
        w = best_w[at]
        better = reach & (
            (d < w) | ((d == w) & ((lo < best_lo[at]) | ((lo == best_lo[at]) & (hi < best_hi[at]))))
        )
        come = np.flatnonzero(better) if rough is None else at[better]
        best_w[come], best_lo[come], best_hi[come] = d[better], lo[better], hi[better]
        if rough is not None:
            nearer[come] = rough.limit(d[better])
        left = np.flatnonzero(outside)
        if not len(left):
            break
        v = left[_nearest_outside(best_w[left], best_lo[left], best_hi[left])]
        if np.isfinite(best_w[v]):
            src.append(best_lo[v])
            dst.append(best_hi[v])
            weight.append(best_w[v])
        else:  # nothing reachable: start the next tree of the forest
            best_w[v] = np.inf
    return (
        np.array(src, dtype=np.int64),
        np.array(dst, dtype=np.int64),
        np.array(weight, dtype=np.float64),
    )


def forest_mask(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """True for the edges of the minimum spanning forest under (w, src, dst).

    Array form of the contraction rounds: every component marks its first edge
    in sorted order, marked links are followed to a root, inner edges fall out.
    """
    m = len(w)
    keep = np.zeros(m, dtype=bool)
    if m == 0:
        return keep
    order = np.lexsort((dst, src, w))
    ends, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = codes[:m][order], codes[m:][order]
    n, live = len(ends), np.flatnonzero(a != b)
    chosen = np.zeros(m, dtype=bool)
    while len(live):
        u, v = a[live], b[live]
        # written from heaviest to lightest, so the lightest edge of a vertex stays
        first, second = np.full(n, m), np.full(n, m)
        first[u[::-1]] = live[::-1]
        second[v[::-1]] = live[::-1]
        first = np.minimum(first, second)
        picked = np.flatnonzero(first < m)
        edge = first[picked]
        chosen[edge] = True
        parent = np.arange(n)
        parent[picked] = np.where(a[edge] == picked, b[edge], a[edge])
        mutual = picked[(parent[parent[picked]] == picked) & (picked < parent[picked])]
        parent[mutual] = mutual
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        a, b = parent[a], parent[b]
        live = live[a[live] != b[live]]
    keep[order] = chosen
    return keep


def follow_pointers(ids: np.ndarray, ptr: np.ndarray, path_min: bool) -> np.ndarray:
    """Smallest id on the forward path of each pointer, or the root it ends in.

    An id that is pointed at but has no row of its own ends its path.
    """
    order = np.argsort(ids)
    ids = ids[order]
    target = ptr[order]
    at = np.minimum(np.searchsorted(ids, target), len(ids) - 1)
    known = ids[at] == target
    hop = np.where(known, at, np.arange(len(ids)))
    if path_min:
        lead = np.minimum(ids, target)
    else:
        here = np.arange(len(ids))
        hop = np.where((hop[hop] == here) & (here < hop), here, hop)
        lead = np.where(known, ids[hop], target)
    while True:
        nxt = np.minimum(lead, lead[hop]) if path_min else lead[hop]
        hop = hop[hop]
        if np.array_equal(nxt, lead):
            break
        lead = nxt
    out = np.empty_like(lead)
    out[order] = lead
    return out


def component_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id of the component) over the ends of a block of edges."""
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        nxt = label.copy()
        # hook the labels of both ends to the smaller one, then shorten all paths
        np.minimum.at(nxt, label[u], low)
        np.minimum.at(nxt, label[v], low)
        while not np.array_equal(nxt[nxt], nxt):
            nxt = nxt[nxt]
        if np.array_equal(nxt, label):
            return ids, ids[label]
        label = nxt


class GrowingTrees:
    """The components of edges that come in total order, chunk by chunk: a number per vertex."""

    def __init__(self):
        self.ids, self.label = np.array([], np.int64), np.array([], np.int64)

    def add(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """True for edges whose ends nothing earlier connects."""
        ends = np.unique(np.concatenate([src, dst]))
        at = np.searchsorted(self.ids, ends)
        new = np.ones(len(ends), dtype=bool)
        there = np.flatnonzero(at < len(self.ids))
        new[there] = self.ids[at[there]] != ends[there]
        old = len(self.ids)
        self.ids = np.insert(self.ids, at[new], ends[new])
        self.label = np.insert(self.label, at[new], np.arange(old, len(self.ids)))
        a, b = (self.label[np.searchsorted(self.ids, e)] for e in (src, dst))
        kept = forest_mask(a, b, np.arange(len(a)))
        joined, lowest = component_labels(a[kept], b[kept])
        moved = np.arange(len(self.ids))
        moved[joined] = lowest
        self.label = moved[self.label]
        return kept
