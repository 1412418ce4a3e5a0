"""Forms for large tables: planar trees, perturbed graphs in blocks, undefined coordinates."""

import itertools
import math

import numpy as np
import pytest

from grovelink.functions.weights import bucket_bounds, bucketize, max_weight, perturb_weights
from grovelink.operators import compare, forest, pairs, perturbed, pivots, planar
from grovelink.plans import graphs
from grovelink.schema import edges_to_arcs


def plain_tree(points, metric):
    """Kruskal over all pairs under (w, smaller id, larger id)."""
    edges = []
    for (i, p), (j, q) in itertools.combinations(sorted(points.items()), 2):
        d = 0.0  # added in order, which sum() doesn't
        for a, b in zip(p, q):
            d += (a - b) * (a - b) if metric == "euclidean" else abs(a - b)
        d = math.sqrt(d) if metric == "euclidean" else d
        edges.append((d, i, j))
    root = {i: i for i in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = set()
    for d, i, j in sorted(edges):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.add((i, j, d))
    return out


def test_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        at = planar.curve_position(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("dim", [2, 3])
def test_planar_tree(make, metric, dim):
    rng = np.random.default_rng(dim)
    blobs = [rng.normal(size=(n, dim)) * s + c for n, s, c in ((90, 1.0, 0), (70, 0.01, 30), (40, 8.0, -60))]
    ties = rng.integers(0, 4, (60, dim)) + 100.0
    x = np.concatenate([*blobs, ties, [[1e6] * dim], [[1e6] * dim]])
    own = x[rng.permutation(len(x))].tolist()
    table = make.points(own + [[float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1)])
    got = forest.complete_forest(table, metric, planar_rows=0, line_rows=0, block_rows=16)
    assert {tuple(r) for r in got.edges.collect()} == plain_tree(dict(enumerate(own)), metric)
    assert got.work["fragments"] > 16 and got.work["pairs"]


def test_planar_small_tables(make):
    for rows in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 3):
        got = forest.complete_forest(make.points(rows), planar_rows=0, line_rows=0, block_rows=2)
        assert {tuple(r) for r in got.edges.collect()} == {(0, i, 0.0) for i in range(1, len(rows))}


def test_planar_distances_grow_with_the_points(make):
    rng = np.random.default_rng(3)
    each = []
    for n in (600, 2400):
        done = forest.complete_forest(make.points(rng.random((n, 2)).tolist()), planar_rows=0, block_rows=64)
        assert done.edges.count() == n - 1
        each.append(done.work["distances"] / n)
    assert each[1] < 1.3 * each[0] and each[1] < 2400 / 8


@pytest.mark.parametrize("beta", [None, 0.2])
@pytest.mark.parametrize("k", [None, 3])
def test_perturbed_graph(spark, make, beta, k):
    rng = np.random.default_rng(4)
    table = make.points(rng.integers(0, 9, (40, 2)).astype(float).tolist())
    rows = perturb_weights(pairs.all_pairs(table), 0.05, 9)
    bounds = None
    if beta is not None:
        top = perturbed.max_perturbed_weight(table, 0.05, 9, block_rows=7)
        assert top == max_weight(rows)
        bounds = bucket_bounds(top, beta, 0.1, 9)
        rows = bucketize(rows, bounds)
    got = perturbed.perturbed_graph(table, 0.05, [9, 8], k, bounds, tie_seed="t", block_rows=7).where("run = 0")
    if k is None:
        want = forest.minimum_spanning_forest(rows).edges
        got = forest.minimum_spanning_forest(got.select("src", "dst", "w")).edges
    else:
        want = pairs.k_nearest_per_vertex(edges_to_arcs(rows), k, tie_seed="t")
        got = pairs.k_nearest_per_vertex(got.select("src", "dst", "w"), k, tie_seed="t")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def uneven(dim, seed):
    """Clusters of different density, copies, a lattice with ties and outliers."""
    rng = np.random.default_rng(seed)
    blobs = [rng.normal(size=(n, dim)) * s + c for n, s, c in ((40, 1.0, 0), (30, 0.001, 30), (10, 40.0, -60))]
    x = np.concatenate([*blobs, rng.integers(0, 3, (30, dim)) + 100.0, np.full((7, dim), 5.0), [[1e5] * dim]])
    return x[rng.permutation(len(x))].tolist()


@pytest.mark.parametrize(
    "metric, dim, beta", [("manhattan", 1, 0.2), ("euclidean", 2, None), ("euclidean", 2, 0.2), ("euclidean", 3, 0.2)]
)
def test_perturbed_nearest(make, metric, dim, beta):
    own = uneven(dim, dim)
    table = make.points(own + [[float("nan")] * dim])
    rows = perturb_weights(pairs.all_pairs(make.points(own), metric), 0.05, 9)
    top, bounds = max_weight(rows), None
    assert perturbed.max_perturbed_weight(table, 0.05, 9, metric) == top
    if beta is not None:
        bounds = bucket_bounds(top, beta, 0.1, 9)
        rows = bucketize(rows, bounds)
    got = perturbed.perturbed_nearest(table.where("not isnan(features[0])"), 0.05, 9, 4, bounds, "t", metric, cell_rows=20)
    want = pairs.k_nearest_per_vertex(edges_to_arcs(rows), 4, tie_seed="t")
    got = pairs.k_nearest_per_vertex(got, 4, tie_seed="t")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_perturbed_nearest_leaves_other_cases(make):
    table = make.points(uneven(2, 1) + [[float("nan")] * 2])
    assert perturbed.perturbed_nearest(table, 0.05, 9, 4, metric="cosine") is None
    assert perturbed.perturbed_nearest(table, 1.0, 9, 4) is None
    assert perturbed.perturbed_nearest(make.points([[0.0], [1.0]]), 0.05, 9, 4) is None


@pytest.mark.parametrize("dim", [1, 2])
def test_heaviest_pair_is_among_far_points(make, dim):
    rng = np.random.default_rng(dim)
    own = np.concatenate([rng.random((600, dim)), np.ones((20, dim)), np.zeros((20, dim))])
    table = make.points(own.tolist())
    far, top = perturbed._far_points(table, 0.05, 9, "euclidean", few=8)
    assert far.count() < 200
    want = max_weight(perturb_weights(pairs.all_pairs(table), 0.05, 9))
    assert top <= want == max_weight(perturb_weights(pairs.all_pairs(far), 0.05, 9))


def test_large_perturbed_graphs_make_no_block_pairs(make, monkeypatch):
    table = make.points(uneven(2, 7))
    options = dict(k=4, buckets=True, gamma=0.05, beta=0.2, alpha=0.1, seed=9)
    want = {tuple(r) for r in graphs.cluster_points(table, **options).final_labels().collect()}
    monkeypatch.setattr(graphs, "perturbed_graph", None)
    got = graphs.cluster_points(table, **options, near_rows=0).final_labels()
    assert {tuple(r) for r in got.collect()} == want


def test_stability_without_pairs(make, spark):
    one = make.points([[0.0], [1.0]])
    assert graphs.stability_runs(one.limit(0), runs=2).count() == 0
    assert graphs.stability_runs(one, runs=2).count() == 4


def test_undefined_coordinates_give_no_pairs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 0.5]), (3, [inf, 0.0]), (4, [inf, 0.0]), (5, [inf, 0.0]),
            (6, [nan, 0.0]), (7, [None, 0.0]), (8, None), (9, [-inf, inf])]
    table = spark.createDataFrame(rows, "id long, features array<double>")
    for metric in ("euclidean", "manhattan", "cosine"):
        met = {(r.src, r.dst) for r in pairs.eps_join(table, 1.0, metric).collect()}
        assert all(a < 3 and b < 3 for a, b in met)
        assert metric == "cosine" or met == {(0, 1), (0, 2), (1, 2)}
    got = {r.id: r.cluster for r in compare.dbscan(table, 1.0, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0} | {i: -1 for i in range(3, 10)}


def many_dimensions(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 6)) * 10
    x = np.concatenate([centres[i % 8] + rng.normal(size=(1, 6)) for i in range(300)])
    return np.concatenate([x, x[:1].repeat(30, axis=0), rng.integers(0, 2, (40, 6))]).tolist()


@pytest.mark.parametrize("metric,part_rows", [("euclidean", 4096), ("manhattan", 11)])
def test_knn_by_pivots(make, metric, part_rows):
    rows = many_dimensions(5)
    arcs, work = pivots.knn_pivots(make.points(rows), 4, metric, part_rows=part_rows)
    want = pairs.knn(make.points(rows), 4, metric)
    assert {tuple(r) for r in arcs.collect()} == {tuple(r) for r in want.collect()}
    assert work["pairs"] < 0.6 * work["places"] * len(rows)
    few = make.points(rows[:3] + [[float("nan")] * 6])
    assert pairs.knn(few, 4, metric, pivot_rows=0).count() == 6
    assert pairs.knn(few.limit(0), 4, metric, pivot_rows=-1).count() == 0


@pytest.mark.parametrize("metric,part_rows", [("euclidean", 4096), ("manhattan", 11)])
def test_threshold_by_pivots(make, metric, part_rows):
    rows = many_dimensions(6)
    for eps in (0.0, 2.5, 6.0):
        edges, work = pivots.eps_join_pivots(make.points(rows), eps, metric, part_rows=part_rows)
        got = [tuple(r) for r in edges.collect()]
        want = pairs.all_pairs(make.points(rows), metric, eps)
        assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in want.collect()}
        assert work["pairs"] < 0.6 * len(rows) ** 2
    assert pairs.eps_join(make.points(rows).limit(0), 1.0, metric, 6, pivot_rows=-1).count() == 0


def test_near_boxes():
    rng = np.random.default_rng(4)
    n, metric = 700, "euclidean"
    low = rng.random((n, 2))
    low = low[np.lexsort((low[:, 1], np.floor(low[:, 0] * 8)))]
    high, core = low + rng.random((n, 2)) * 0.02, rng.random(n) * 0.05
    place, gap = rng.permutation(n), rng.random(n) * 0.1
    runs, near = planar.near_boxes(low, high, core, place, gap, metric)
    got = {(int(a), int(b)): w for r in range(runs) for a, b, w, _ in zip(*near(r))}
    want = {}
    for i in range(n):
        away = np.maximum(planar.box_distance(low[i], high[i], low, high, metric), np.maximum(core, core[i]))
        for j in range(i + 1, n):
            bound = gap[min(place[i], place[j]) : max(place[i], place[j])].max()
            if away[j] <= bound:
                want[i, j] = bound
    assert got == want and len(want) > n


def test_planar_lines_and_many_fragments(make, monkeypatch):
    """Points on lines far from each other: fragments meet few others, and there are never too many of them."""
    rng = np.random.default_rng(8)
    rows = [[float(x), 400.0 * (i % 5)] for i, x in enumerate(rng.integers(0, 1_000_000, 1200) / 100)]
    rows += rows[:100]
    done = forest.complete_forest(make.points(rows), planar_rows=0, line_rows=0, block_rows=16)
    assert done.work["pairs"] <= 8 * done.work["fragments"]
    want = plain_tree(dict(enumerate(rows)), "euclidean")
    assert {tuple(r) for r in done.edges.collect()} == want
    monkeypatch.setattr(planar, "MOST_FRAGMENTS", 64)
    few = forest.complete_forest(make.points(rows), planar_rows=0, line_rows=0, block_rows=16)
    assert 0 < few.work["fragments"] <= 64
    assert {tuple(r) for r in few.edges.collect()} == want
