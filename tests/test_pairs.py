import math

import brute
import pytest
from pyspark.sql import functions as F

from grovelink.functions.distance import distance
from grovelink.operators import pairs


def triples(df):
    return sorted((r["src"], r["dst"], r["w"]) for r in df.collect())


@pytest.mark.parametrize("block_rows", [3, 2048])
def test_all_pairs_any_block_size(make, block_rows):
    points = brute.random_points(20, 3, 1)
    got = triples(pairs.all_pairs(make.points(points), block_rows=block_rows))
    assert got == sorted(brute.complete(points))


def test_metrics_match_column_form(make):
    points = [[0.0, 0.0], [1.0, 0.0], [2.0, 3.0], [-1.0, 4.0]]
    v = make.points(points)
    for metric in ("euclidean", "manhattan", "cosine"):
        a, b = v.alias("a"), v.alias("b")
        want = (
            a.join(b, F.col("a.id") < F.col("b.id"))
            .select(
                F.col("a.id").alias("src"),
                F.col("b.id").alias("dst"),
                distance(F.col("a.features"), F.col("b.features"), metric).alias("w"),
            )
            .collect()
        )
        want = {(r["src"], r["dst"]): r["w"] for r in want}
        got = {(s, d): w for s, d, w in triples_null(pairs.all_pairs(v, metric))}
        assert got.keys() == want.keys()
        for key, w in want.items():
            assert (w is None and got[key] is None) or math.isclose(w, got[key])
        if metric == "cosine":  # a zero vector has no direction
            assert got[0, 1] is None


def triples_null(df):
    return [(r["src"], r["dst"], r["w"]) for r in df.collect()]


def test_errors(make):
    with pytest.raises(ValueError):
        pairs.all_pairs(make.points([[0.0], [1.0]]), "hamming")
    with pytest.raises(Exception, match="same length"):
        pairs.all_pairs(make.points([[0.0], [1.0, 2.0]])).collect()


def test_threshold_and_limit(make):
    points = brute.random_points(30, 2, 2)
    want = sorted(e for e in brute.complete(points) if e[2] <= 3.0)
    near = pairs.all_pairs(make.points(points), threshold=3.0, block_rows=8)
    assert triples(near) == want
    assert triples(pairs.limit_edges(near, 7)) == want[:7]
    assert triples(pairs.limit_edges(near, None)) == want


@pytest.mark.parametrize("dim", [1, 2, 3])
@pytest.mark.parametrize("cell_rows", [3, 20000])
def test_knn_grid(make, dim, cell_rows):
    far = [[1e6] * dim, [-300.0] * dim]
    points = brute.random_points(60, dim, 3, step=0.5) + [[2.0] * dim] * 30 + far
    from grovelink.lookup import SHUFFLE_ONLY, Limits
    from grovelink.operators.grid import knn_grid

    for limits in (Limits(), SHUFFLE_ONLY)[: 1 + (dim == 2)]:
        got = triples(knn_grid(make.points(points), 4, "euclidean", dim, cell_rows, limits))
        assert got == brute.knn(points, 4)


def test_knn_grid_few_points(make):
    assert len(triples(pairs.knn(make.points([[0.0], [0.0], [9.0]]), 5, grid_rows=0))) == 6


@pytest.mark.parametrize("block_rows", [4, 2048])
def test_knn_ties_and_copies(make, block_rows):
    points = brute.random_points(25, 2, 3, step=2.5) + [[0.0, 0.0]] * 9
    got = triples(pairs.knn(make.points(points), 4, block_rows=block_rows))
    assert got == brute.knn(points, 4)
    assert all(s != d for s, d, _ in got)


def test_knn_more_neighbours_than_points(make):
    points = brute.random_points(4, 2, 4)
    assert len(triples(pairs.knn(make.points(points), 10))) == 12


def test_knn_symmetric(make):
    points = brute.random_points(15, 2, 5)
    want = {}
    for s, d, _ in brute.knn(points, 3):
        want[s, d] = want.get((s, d), 0.0) + 0.5
        want[d, s] = want.get((d, s), 0.0) + 0.5
    got = pairs.knn_symmetric(make.points(points), 3)
    assert {(s, d): w for s, d, w in triples(got)} == want


@pytest.mark.parametrize("dim", [1, 2, 3, 4])
@pytest.mark.parametrize("cell_rows", [2, 20000])
def test_eps_join_with_a_hot_cell(make, dim, cell_rows):
    points = brute.random_points(40, dim, 6) + [[5.0] * dim] * 20
    points = [[x - 5.0 for x in p] for p in points]
    want = sorted(e for e in brute.complete(points) if e[2] <= 1.5)
    assert triples(pairs.eps_join(make.points(points), 1.5, cell_rows=cell_rows)) == want


def test_eps_join_at_exact_cell_borders(make):
    points = [[i * 0.1] for i in range(50)]
    want = sorted(e for e in brute.complete(points) if e[2] <= 0.1)
    assert triples(pairs.eps_join(make.points(points), 0.1)) == want


def test_shuffled_ties_stay_within_equal_weights(make):
    arcs = make.edges([(0, d, 1.0 + (d > 6)) for d in range(1, 12)])
    picks = [
        triples(pairs.k_nearest_per_vertex(arcs, 8, tie_seed=s)) for s in range(4)
    ]
    for p in picks:
        assert len(p) == 8 and sum(w == 1.0 for _, _, w in p) == 6
    assert len({str(p) for p in picks}) > 1


@pytest.mark.parametrize("grid_rows", [0, 100])
def test_undefined_coordinates_have_no_neighbours(spark, grid_rows):
    points = [(0, [1.0, 0.0]), (1, [math.nan, 0.0]), (2, [2.0, 0.0]), (3, [None, 1.0]), (4, [0.0, math.inf])]
    v = spark.createDataFrame(points, "id long, features array<double>")
    assert triples(pairs.knn(v, 2, grid_rows=grid_rows)) == [(0, 2, 1.0), (2, 0, 1.0)]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_first_pairs_meet_few_vertices(make, monkeypatch, metric):
    points = brute.random_points(200, 9, 3)
    table = make.points(points)
    copies = table.where("id in (0, 1, 150)")  # a repeated id repeats its pairs
    table = table.union(copies)
    every = sorted(triples(pairs.all_pairs(table, metric)), key=lambda e: e[:2])
    threshold = sorted(w for *_, w in every)[len(every) // 4]
    want = [e for e in every if e[2] <= threshold]
    monkeypatch.setattr(pairs, "NEAR_ROWS", 64)
    monkeypatch.setattr(pairs, "FIRST_IDS", 2)
    for count in (40, 500):
        some = pairs.all_pairs(table, metric, threshold, first=count)
        assert triples(pairs.limit_edges(some, count)) == want[:count]
        # no pair of the larger ids has been made
        assert max(s for s, *_ in triples(some)) < 20
    none = pairs.all_pairs(table, metric, threshold, first=len(want) + 5)
    assert triples(none) == want
