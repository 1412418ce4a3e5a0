import math
import random
import warnings

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelink import schema
from grovelink.lookup import SHUFFLE_ONLY, Limits
from grovelink.operators import forest, kernels
from grovelink.plans import graphs


def triples(df):
    return sorted((r["src"], r["dst"], r["w"]) for r in df.collect())


def msf(edges, **options):
    return triples(forest.minimum_spanning_forest(edges, **options).edges)


def test_path_and_cut(make):
    edges = make.edges([(0, 1, 1), (1, 2, 2), (2, 3, 3), (0, 3, 9)])
    tree = forest.minimum_spanning_forest(edges).edges
    assert triples(tree) == [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 3.0)]
    got = graphs.cut_clusters(tree, make.ids(range(4)), 2).collect()
    assert {r["id"]: r["comp"] for r in got} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_ties_follow_total_order(make):
    rows = [(a, b, 1.0) for a in range(4) for b in range(a + 1, 4)]
    want = [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0)]
    assert msf(make.edges(rows)) == want
    assert msf(make.edges(rows), limits=SHUFFLE_ONLY) == want
    points = make.points([[0.0, 0.0]] * 4)
    assert [e[:2] for e in triples(forest.complete_forest(points).edges)] == [e[:2] for e in want]


def test_disconnected_warns(make):
    edges = make.edges([(0, 1, 1), (1, 2, 2), (0, 2, 3), (3, 4, 1)])
    with pytest.warns(UserWarning, match="not connected"):
        done = forest.minimum_spanning_forest(edges, make.ids(range(6)), warn=True)
    assert done.size == 3 and len(triples(done.edges)) == 3
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        forest.minimum_spanning_forest(make.edges([(0, 1, 1)]), warn=True)


def test_duplicates_and_loops(make):
    edges = make.edges([(1, 2, 5), (2, 1, 3), (1, 2, 4), (1, 1, 0)])
    assert triples(schema.canonical_edges(edges)) == [(1, 2, 3.0)]
    assert msf(edges) == [(1, 2, 3.0)]


@pytest.mark.parametrize("seed", range(3))
def test_all_routes_agree(make, seed):
    rows = brute.random_edges(60, 500, seed)
    random.Random(seed).shuffle(rows)
    want = brute.kruskal(rows)
    edges = make.edges([(b, a, w) if i % 2 else (a, b, w) for i, (a, b, w) in enumerate(rows)])
    for options in (
        {"sparsifier": "vertex"},
        {"sparsifier": "two_way"},
        {"sparsifier": "hash"},
        {"sparsifier": None},
        {"sparsifier": "vertex", "limits": Limits(finish_edges=100)},
        {"sparsifier": None, "limits": SHUFFLE_ONLY},
    ):
        assert msf(edges, **options) == want


def test_complete_forest_matches(make):
    points = brute.random_points(90, 3, 8, step=1.0)
    want = brute.kruskal(brute.complete(points))
    v = make.points(points)
    assert triples(forest.complete_forest(v).edges) == want
    assert triples(forest.complete_forest(v, block_rows=13).edges) == want


def test_sparsifier_ends_on_a_size_that_stalls_unsalted(make):
    points = brute.random_points(100, 8, 9)
    rows = brute.complete(points)
    for name in ("vertex", "two_way", "hash"):
        done = forest.minimum_spanning_forest(make.edges(rows), sparsifier=name)
        assert triples(done.edges) == brute.kruskal(rows)
        assert len(done.rounds) <= 8
        assert all(after <= before for before, after in done.rounds)


def test_bucket_msf_flags_every_edge(make, monkeypatch):
    rows = brute.random_edges(30, 200, 11)
    edges = make.edges(rows)
    got = forest.bucket_msf(edges, F.col("dst") % 3, 3).collect()
    assert len(got) == 200
    for bucket in range(3):
        kept = sorted((r["src"], r["dst"], r["w"]) for r in got if r["dst"] % 3 == bucket and r["kept"])
        assert kept == brute.kruskal([e for e in rows if e[1] % 3 == bucket])


def test_bucket_read_in_chunks(make, monkeypatch):
    rows = brute.random_edges(40, 400, 12)
    monkeypatch.setattr(forest, "BUCKET_EDGES", 50)
    run = forest._forest_filter(True)
    import pyarrow as pa

    batches = [
        pa.RecordBatch.from_pydict(
            {"src": [a for a, _, _ in part], "dst": [b for _, b, _ in part], "w": [w for *_, w in part]}
        )
        for part in (rows[i : i + 30] for i in range(0, 400, 30))
    ]
    out = [r for b in run((), iter(batches)) for r in b.to_pylist()]
    assert len(out) == 400
    assert sorted((r["src"], r["dst"], r["w"]) for r in out if r["kept"]) == brute.kruskal(rows)


def test_forest_mask_on_random_blocks():
    import numpy as np

    for seed in range(20):
        rows = brute.random_edges(25, 80, seed, weights=5)
        src, dst, w = (np.array(c) for c in zip(*rows))
        keep = kernels.forest_mask(src, dst, w)
        assert sorted(rows[i] for i in np.flatnonzero(keep)) == brute.kruskal(rows)


def test_edges_between_and_removal(make):
    edges = make.edges([(0, 1, 1), (1, 2, 2), (2, 3, 3), (0, 3, 4), (1, 3, 5)])
    u, v = make.ids([0, 1]), make.ids([1, 3])
    assert triples(forest.edges_between(edges, u, v)) == [(0, 1, 1.0), (0, 3, 4.0), (1, 3, 5.0)]
    gone = make.edges([(0, 3, 4), (2, 3, 3)])
    assert triples(forest.remove_edges(edges, gone)) == [(0, 1, 1.0), (1, 2, 2.0), (1, 3, 5.0)]
    assert triples(forest.forest_in_cluster(edges, make.ids([0, 2]))) == [
        (0, 1, 1.0), (0, 3, 4.0), (2, 3, 3.0)
    ]


@pytest.mark.parametrize("limits", [Limits(), SHUFFLE_ONLY])
def test_line_forest(make, limits):
    points = brute.random_points(40, 1, 13, step=0.5) + [[4.0]] * 10
    want = brute.kruskal(brute.complete(points))
    got = forest.complete_forest(make.points(points), limits=limits, line_rows=0).edges
    assert triples(got) == want


def test_removed_edges(make):
    rows = brute.random_edges(20, 90, 14)
    flagged = forest.bucket_msf(make.edges(rows), F.lit(0), 1)
    kept = brute.kruskal(rows)
    assert triples(forest.removed_edges(flagged)) == sorted(e for e in rows if e not in kept)


def test_empty_graph(make):
    assert msf(make.edges([])) == []
    assert triples(forest.complete_forest(make.points([[1.0]])).edges) == []


@pytest.mark.parametrize("line_rows", [0, 100])
def test_undefined_coordinates_have_no_edges(spark, line_rows):
    points = [(0, [1.0]), (1, [math.nan]), (2, [2.0]), (3, [None]), (4, [math.nan]), (5, [math.inf])]
    v = spark.createDataFrame(points, "id long, features array<double>")
    assert triples(forest.complete_forest(v, line_rows=line_rows).edges) == [(0, 2, 1.0)]


def test_bucket_flags_hold_no_edges(make, monkeypatch):
    """Copies, loops, no bucket and no weight; what a task holds has nothing but a number per vertex."""
    rows = brute.random_edges(40, 300, 13)
    rows += [(b, a, w) for a, b, w in rows[:60]] + rows[60:100] + [(3, 3, 0.5), (4, 4, 0.1)]
    edges = make.edges(rows).withColumn("w", F.when(F.col("w") != rows[5][2], F.col("w")))
    bucket = F.when(F.col("src") % 5 != 4, F.col("src") % 5)
    want = {}
    for r in edges.withColumn("b", bucket).collect():
        want.setdefault(r["b"], []).append((r["src"], r["dst"], float("inf") if r["w"] is None else r["w"]))
    want = {b: (len(own), weights(brute.kruskal(own))) for b, own in want.items()}
    for chunk in (7, 1_000_000):
        monkeypatch.setattr(forest, "BUCKET_EDGES", chunk)
        got = {}
        for r in forest.bucket_msf(edges, bucket, 3).withColumn("b", bucket).collect():
            w = float("inf") if r["w"] != r["w"] else r["w"]
            got.setdefault(r["b"], []).append((r["src"], r["dst"], w, r["kept"]))
        assert {b: (len(own), weights(e[:3] for e in own if e[3])) for b, own in got.items()} == want
    trees = kernels.GrowingTrees()
    for at in range(50):
        trees.add(np.arange(at * 100, at * 100 + 100), np.arange(at * 100 + 1, at * 100 + 101))
    assert len(trees.ids) == 5001 and not trees.label.any()


def weights(edges):
    return sorted((min(a, b), max(a, b), w) for a, b, w in edges)
