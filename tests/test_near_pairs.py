"""Near pairs by a matrix product, pivots that send a query once per block, edges that never pile up."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelink.functions.hashing import hashed_uniform
from grovelink.lookup import Limits
from grovelink.operators import components, forest, kernels, pairs, perturbed, pivots, stats
from grovelink.plans import graphs
from grovelink.scratch import Scratch


def rows_of(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    return np.concatenate([x, x[: n // 4], rng.integers(0, 2, (n // 4, dims)), np.zeros((2, dims))])


@pytest.mark.parametrize("metric,bound", [("euclidean", 5.0), ("cosine", 0.9), ("manhattan", 16.0)])
def test_near_pairs_are_those_of_all_distances(metric, bound):
    a, b = rows_of(1, 60), rows_of(2, 90)
    b[:20] = a[:20]
    d = kernels.block_distances(a, b, metric)
    for limit, k in ((bound, None), (None, 4), (bound, 4)):
        within = np.where(d <= (np.inf if limit is None else limit), d, np.nan)
        want = ~np.isnan(within) if k is None else kernels.nearest_mask(within, k)
        rows = None if limit is None else np.full(len(a), limit)
        i, j, w = (np.concatenate(c) for c in zip(*kernels.near_pairs(a, b, metric, rows, k)))
        got = np.zeros(d.shape, dtype=bool)
        got[i, j] = True
        assert np.array_equal(got, want) and got.sum() == len(i) and np.array_equal(w, d[i, j])


def test_near_pairs_with_odd_numbers():
    a = rows_of(3, 20)
    for odd in (np.nan, np.inf, 1e200, 1e-170):
        x = a.copy()
        x[3, 2] = odd
        with np.errstate(all="ignore"):
            d = kernels.block_distances(x, x, "euclidean")
            i, j, _ = (np.concatenate(c) for c in zip(*kernels.near_pairs(x, x, "euclidean", np.full(len(x), 4.0))))
        assert set(zip(i, j)) == set(zip(*np.nonzero(d <= 4.0)))


def test_forest_by_products():
    x = rows_of(4, 120)
    ids = np.random.default_rng(5).permutation(len(x)) * 3
    for side in (None, ids % 2):
        i, j = np.triu_indices(len(x), 1) if side is None else np.nonzero((side[:, None] == 0) & (side[None, :] == 1))
        lo, hi = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        w = kernels.block_distances(x, x, "euclidean")[i, j]
        keep = kernels.forest_mask(lo, hi, w)
        got = kernels.dense_forest(ids, x, side, "euclidean")
        assert set(zip(*got)) == set(zip(lo[keep], hi[keep], w[keep]))


def test_forest_measures_few_distances(monkeypatch):
    x, measured = rows_of(6, 400), []
    plain = kernels.block_distances

    def counted(a, b, metric):
        measured.append(len(a) * len(b))
        return plain(a, b, metric)

    monkeypatch.setattr(kernels, "block_distances", counted)
    kernels.dense_forest(np.arange(len(x)), x, None, "euclidean")
    assert sum(measured) < 0.2 * len(x) ** 2


def test_query_goes_once_to_a_block(make, spark):
    points = make.points(rows_of(7, 400).tolist()).select("id", "features")
    scratch = Scratch(spark, "test")
    n = points.count()
    cells = pivots._cells(scratch, points, n, "euclidean", 24)
    asking = cells.points.df.selectExpr("id", "features", "double('infinity') as bound")
    visits = pivots._visits(cells, asking, None, part_rows=150)
    used = len(visits.blocks)
    # every query visits all 24 cells, yet it is copied only once per block
    assert visits.pairs == n * n and used < 12 and visits.sent.count() == n * used


def test_a_task_keeps_one_link_per_vertex(spark):
    edges = spark.range(0, 200).coalesce(1).selectExpr("id as src").crossJoin(spark.range(0, 200).selectExpr("id as dst"))
    kept = components._squeezed(edges.selectExpr("least(src, dst) a", "greatest(src, dst) b").coalesce(1))
    assert kept.count() == 199
    many = edges.where("src % 7 = dst % 7").unionByName(spark.sql("select 900L src, 900L dst union all select 901L, null"))
    got = {r["id"]: r["comp"] for r in components.connected_components(many).collect()}
    assert got == {**{i: i % 7 for i in range(200)}, 900: 900, 901: 901}


def test_links_that_a_task_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK_PAIRS", 16)
    monkeypatch.setattr(components, "HELD_LINKS", 16)
    chain = spark.range(0, 300).selectExpr("id as src", "id + 2 as dst")
    got = {r["id"]: r["comp"] for r in components.connected_components(chain).collect()}
    assert got == {i: i % 2 for i in range(302)}


@pytest.mark.parametrize("margin", [0.001, 0.0, 0.4])
def test_summary_stores_no_edges(spark, make, monkeypatch, margin):
    monkeypatch.setattr(stats, "MEDIAN_MARGIN", margin)
    weights = np.random.default_rng(8).integers(0, 40, 3001) / 4.0
    edges = make.edges([(i, i + 1, w) for i, w in enumerate(weights)])
    stored, store = [], Scratch.store

    def watched(self, *args, **options):
        stored.append(store(self, *args, **options))
        return stored[-1]

    monkeypatch.setattr(Scratch, "store", watched)
    for rows in (3001, 3000, 2, 1):
        got = stats.graph_summary(make.ids(range(4)), edges.where(f"src < {rows}"), ["x"]).first()
        assert got["median_edge_weight"] == statistics.median(weights[:rows]) and got["num_edges"] == rows
        assert got["min_edge_weight"] == min(weights[:rows]) and got["max_edge_weight"] == max(weights[:rows])
    assert max(s.rows for s in stored) < 100
    empty = stats.graph_summary(make.ids(range(4)), edges.where("src < 0"), ["x"]).first()
    assert empty["num_edges"] == 0 and empty["median_edge_weight"] is None


def test_forests_of_a_task_are_small():
    # a squeeze of so many edges and as many new ones takes about a hundred bytes per edge, several times
    assert forest.FOREST_EDGES <= 1_000_000


def places(seed, n):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.integers(0, 60, (n, 2)) * 1.5, rng.normal(size=(n, 2)) + 300.0]).tolist()


def test_labels_from_the_forest_alone(make, monkeypatch):
    points = make.points(places(9, 60))
    want = graphs.cluster_points(points)
    monkeypatch.setattr(graphs, "complete_forest_candidates", None)
    got = graphs.cluster_points(points, planar_rows=0)
    for part in (lambda h: h.labels(), lambda h: h.merges, lambda h: h.final_labels()):
        assert {tuple(r) for r in part(got).collect()} == {tuple(r) for r in part(want).collect()}


def test_stability_from_near_pairs(make, monkeypatch):
    points = make.points(places(10, 50) + [[1.0, 2.0]] * 5)
    want = {tuple(r) for r in graphs.stability_runs(points, 4).collect()}
    monkeypatch.setattr(graphs, "perturbed_graph", None)
    got = {tuple(r) for r in graphs.stability_runs(points, 4, near_rows=0).collect()}
    assert got == want and len(got) == 4 * 105


def test_draws_of_whole_arrays_are_those_of_the_rows(spark):
    rng = np.random.default_rng(4)
    a = np.r_[[0, 9, 10, 99, 100, 10**18, 2**63 - 1], 10 ** rng.integers(0, 18, 300) - rng.integers(0, 2, 300)].astype(np.int64)
    b = np.r_[[2**63 - 1, 0, 10**18 - 1], rng.integers(0, 2**62, 304)].astype(np.int64)
    rows = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    for seed in (0, 7, "s/1", "a seed that is too long for one block", -3):
        want = [r[0] for r in rows.select(hashed_uniform(seed, "a", "b")).collect()]
        assert perturbed.draws(seed, a, b).tolist() == want
        assert perturbed.draws(seed, -a, b).tolist()[3] != want[3]


def test_copies_of_places_are_drawn_in_lists(make, monkeypatch):
    # places far apart with many copies, a line of close points, lists that are cut
    points = [[100.0 * (i % 4), 70.0 * (i // 4)] for i in range(8)] * 9 + [[1000.0 + i * i / 7, 5.0] for i in range(30)]
    table = make.points(points)
    want = {tuple(r) for r in graphs.stability_runs(table, 3).collect()}
    monkeypatch.setattr(perturbed, "HASHED", 2)
    monkeypatch.setattr(perturbed, "LISTED", 3)
    drawn = []
    near = perturbed._near_by_levels
    monkeypatch.setattr(perturbed, "_near_by_levels", lambda *a: drawn.append(near(*a)) or drawn[-1])
    limits = Limits(finish_edges=0)  # the levels of a large tree
    got = {tuple(r) for r in graphs.stability_runs(table, 3, near_rows=0, limits=limits).collect()}
    assert got == want and len(got) == 3 * 102
    # of 5,151 pairs the 288 of copies aren't drawn, nor are those that shorter steps connect
    pairs, zero = drawn[0]
    assert pairs.select(F.sum(F.size("a") * F.size("b"))).first()[0] < 4000 and zero.count() == 64


def test_blocks_of_several_pieces_give_the_same_forest(make, monkeypatch):
    points = make.points(rows_of(6, 200).round(1))
    sizes = []
    inner = pairs._block_pairs
    monkeypatch.setattr(pairs, "_block_pairs", lambda v, size, rows: sizes.append(size) or inner(v, size, rows))
    want = forest.complete_forest(points, block_rows=1000).edges
    got = forest.complete_forest(points, block_rows=4).edges
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert sizes == [1000, 4 * (302 // 64)] and 302 // 64 > 1
