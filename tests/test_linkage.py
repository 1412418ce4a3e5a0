import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelink import schema
from grovelink.lookup import DEFAULT_LIMITS, SHUFFLE_ONLY, Limits, lookup
from grovelink.operators import components, contraction, kernels
from grovelink.operators.agglomerate import agglomerate, tag_run, untag
from grovelink.plans import graphs


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def check(done, arcs, ids, stop=3):
    rounds, merges = brute.linkage(arcs, ids, stop)
    assert done.rounds == [len(rounds)]
    want = sorted((i + 1, v, lab[v]) for i, lab in enumerate(rounds) for v in lab)
    assert rows_of(done.labels(), "round", "id", "label") == want
    got = {r["id"]: (r["leader"], r["parent"], r["round"]) for r in done.merges.collect()}
    assert got == merges
    last = rounds[-1] if rounds else {v: v for v in ids}
    assert rows_of(done.final_labels(), "id", "label") == sorted(last.items())


def test_best_neighbour_ties_and_isolated(make):
    arcs = make.edges([(0, 2, 1), (0, 1, 1), (1, 0, 5)])
    best = contraction.best_neighbours(arcs, make.ids(range(4)))
    assert {r["id"]: r["nbr"] for r in best.collect()} == {0: 1, 1: 0, 2: 2, 3: 3}


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, SHUFFLE_ONLY])
def test_leader_modes(make, spark, limits):
    best = spark.createDataFrame([(0, 5), (5, 6), (6, 5)], "id long, nbr long")
    got = contraction.find_leaders(best, limits=limits)
    assert dict(rows_of(got, "id", "leader")) == {0: 0, 5: 5, 6: 5}
    got = contraction.find_leaders(best, "component_min", limits=limits)
    assert dict(rows_of(got, "id", "leader")) == {0: 0, 5: 0, 6: 0}


def test_follow_pointers_kernel():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randint(1, 30)
        links = {v * 3: rng.randrange(n + 2) * 3 for v in range(n)}
        ids = np.array(list(links))
        got = kernels.follow_pointers(ids, np.array(list(links.values())), True)
        assert dict(zip(ids.tolist(), got.tolist())) == brute.path_min(links)


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, SHUFFLE_ONLY])
def test_long_pointer_chain(spark, limits):
    links = {v: v - 1 if v else 0 for v in range(200)}
    best = spark.createDataFrame(list(links.items()), "id long, nbr long")
    got = contraction.find_leaders(best, limits=limits)
    assert dict(rows_of(got, "id", "leader")) == {v: 0 for v in links}


def test_contract(make, spark):
    arcs = make.edges([(0, 1, 1), (0, 2, 5), (1, 2, 4), (1, 3, 7), (2, 0, 5), (4, 0, 2)])
    leaders = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "id long, leader long")
    for limits in (DEFAULT_LIMITS, SHUFFLE_ONLY):
        got = contraction.contract(arcs, leaders, limits)
        assert rows_of(got, "src", "dst", "w") == [(0, 2, 4.0), (2, 0, 5.0), (4, 0, 2.0)]


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, SHUFFLE_ONLY])
def test_agglomerate_directed(make, limits):
    points = brute.random_points(40, 2, 21, step=0.5)
    arcs = brute.knn(points, 3)
    done = agglomerate(make.edges(arcs), make.ids(range(40)), limits=limits)
    check(done, arcs, range(40))


def test_agglomerate_complete_from_forest(make):
    points = brute.random_points(50, 2, 22, step=0.5)
    edges = brute.complete(points)
    arcs = edges + [(b, a, w) for a, b, w in edges]
    check(graphs.cluster_points(make.points(points)), arcs, range(50))


def test_small_inputs(make):
    tiny = agglomerate(make.edges([(0, 1, 1), (1, 0, 1)]), make.ids([0, 1]))
    assert tiny.rounds == [0] and rows_of(tiny.final_labels(), "id", "label") == [(0, 0), (1, 1)]
    assert tiny.labels().count() == 0
    sink = agglomerate(make.edges([(0, 5, 1)]), make.ids([0, 5, 6, 7]))
    assert sink.rounds == [0]
    assert rows_of(sink.merges, "id", "leader", "parent") == [(v, v, v) for v in (0, 5, 6, 7)]


def test_contracted_graph(make):
    points = brute.random_points(30, 2, 23)
    arcs = brute.knn(points, 4)
    done = agglomerate(make.edges(arcs), make.ids(range(30)), num_clusters=8)
    rounds, _ = brute.linkage(arcs, range(30), 8)
    want = {}
    for a, b, w in arcs:
        s, d = rounds[-1][a], rounds[-1][b]
        if s != d:
            want[s, d] = min(w, want.get((s, d), w))
    assert {(a, b): w for a, b, w in rows_of(done.graph, "src", "dst", "w")} == want


def test_runs_share_rounds(make, spark):
    graphs_ = [brute.knn(brute.random_points(n, 2, 30 + n), 2) for n in (5, 20, 33)]
    ids = [range(5), range(20), range(33)]
    arcs = [(r, a, b, w) for r, g in enumerate(graphs_) for a, b, w in g]
    df = spark.createDataFrame(arcs, "run int, a long, b long, w double").select(
        tag_run(F.col("a"), F.col("run")).alias("src"),
        tag_run(F.col("b"), F.col("run")).alias("dst"),
        "w",
    )
    everyone = spark.createDataFrame(
        [(r, v) for r, vs in enumerate(ids) for v in vs], "run int, v long"
    ).select(tag_run(F.col("v"), F.col("run")).alias("id"))
    done = agglomerate(df, everyone, runs=3)
    merges = done.merges.collect()
    for r in range(3):
        rounds, want = brute.linkage(graphs_[r], ids[r])
        assert done.rounds[r] == len(rounds)
        mine = {
            m["id"] & ((1 << 40) - 1): (m["leader"] & ((1 << 40) - 1), m["parent"] & ((1 << 40) - 1), m["round"])
            for m in merges
            if m["id"] >> 40 == r
        }
        assert mine == want
    per_run = done.labels().groupBy((F.col("id") / (1 << 40)).cast("int").alias("r")).agg(F.max("round"))
    assert {x[0]: x[1] for x in per_run.collect()} == {
        r: done.rounds[r] for r in range(3) if done.rounds[r]
    }


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, Limits(finish_edges=3), SHUFFLE_ONLY])
def test_components(make, limits):
    rows = brute.random_edges(60, 45, 41) + [(70, 70, 1.0)]
    got = components.connected_components(make.edges(rows), make.ids(range(65)), limits)
    assert dict(rows_of(got, "id", "comp")) == brute.components(range(65), rows)


def test_components_of_a_star_and_a_path(make):
    star = [(v, 1000, 1.0) for v in range(50)]
    path = [(2000 + v, 2001 + v, 1.0) for v in range(60)]
    for limits in (DEFAULT_LIMITS, SHUFFLE_ONLY):
        got = components.connected_components(make.edges(star + path), limits=limits)
        assert dict(rows_of(got, "id", "comp")) == brute.components([], star + path)


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, SHUFFLE_ONLY])
def test_lookup_with_a_hot_key(spark, limits):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("key"), "id"
    ).withColumnRenamed("id", "row")
    table = spark.range(0, 400).select("id", (F.col("id") * 10).alias("val"))
    got = lookup(left, 3000, "key", table, 400, {"val": "out"}, limits).collect()
    assert len(got) == 3000
    assert all(r["out"] == (r["key"] * 10 if r["key"] < 400 else None) for r in got)


def test_adjacency_splits_big_vertices(make):
    arcs = make.edges([(0, d, 100 - d) for d in range(1, 40)] + [(1, 0, 2)])
    nested = schema.nested_adjacency(arcs, max_entries=10).collect()
    assert sum(len(r["nbrs"]) for r in nested) == 40
    assert max(r["part"] for r in nested if r["id"] == 0) >= 1
    for r in nested:
        weights = [e["w"] for e in r["nbrs"]]
        assert weights == sorted(weights)


def test_stability_study(make):
    points = brute.random_points(20, 2, 50)
    got = {(r["run_a"], r["run_b"]): r["diff"] for r in graphs.stability_study(make.points(points), 3).collect()}
    assert len(got) == 9
    assert all(got[a, a] == 0 and got[a, b] == got[b, a] for a in range(3) for b in range(3))


@pytest.mark.parametrize("offset", [-100, 1 << 41])
def test_stability_with_ids_of_any_size(make, offset):
    # evenly spaced ids that are shifted keep their order, so only the draws differ
    points = make.points([[float(x * x)] for x in range(7)])
    wide = points.withColumn("id", F.col("id") + F.lit(offset))
    runs = graphs.stability_runs(wide, 2, num_clusters=2, gamma=0.0)
    plain = graphs.stability_runs(points, 2, num_clusters=2, gamma=0.0)
    want = [(r, i + offset, v + offset) for r, i, v in rows_of(plain, "run", "id", "val")]
    assert rows_of(runs, "run", "id", "val") == want
