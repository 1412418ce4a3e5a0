"""Density hierarchy against plain versions and against dbscan."""

import math

import pytest
from brute import complete, components, euclidean, kruskal, random_points

from grovelink.lookup import SHUFFLE_ONLY
from grovelink.operators import compare, density


def plain_cores(points, k):
    return [sorted(euclidean(p, q) for q in points)[k - 1] if len(points) >= k else None for p in points]


def plain_links(points, k):
    core = plain_cores(points, k)
    return [(a, b, max(w, core[a], core[b])) for a, b, w in complete(points)]


def plain_hierarchy(points, levels, k, size):
    """(rows, labels), by recursion from the loosest level."""
    core, links = plain_cores(points, k), plain_links(points, k)
    comps = []
    for eps in levels:
        label = components([i for i, c in enumerate(core) if c <= eps], [e for e in links if e[2] <= eps])
        groups = {}
        for v, c in label.items():
            groups.setdefault(c, set()).add(v)
        comps.append({c: g for c, g in groups.items() if len(g) >= size})
    gap = [1 / a - 1 / b for a, b in zip(levels, levels[1:])] + [1 / levels[-1]]

    def best(level, c):
        """(mass, picks) of the branch that ends here or of those inside it."""
        mass, top = 0.0, (level, c)
        while True:
            inside = comps[level][c]
            mass += len(inside) * gap[level]
            kids = [d for d, g in comps[level - 1].items() if g <= inside] if level else []
            level -= 1
            if len(kids) != 1:
                break
            c = kids[0]
        inner = [best(level, d) for d in kids]
        total = sum(m for m, _ in inner)
        return (mass, [top]) if mass >= total else (total, [p for _, picks in inner for p in picks])

    chosen = [p for c in comps[-1] for p in best(len(levels) - 1, c)[1]]
    labels = dict.fromkeys(range(len(points)), -1)
    for level, c in chosen:
        labels |= dict.fromkeys(comps[level][c], c)
    rows = {(level, c, len(g), (level, c) in chosen) for level, cs in enumerate(comps) for c, g in cs.items()}
    return rows, labels


def blobs(seed):
    a = [[x / 4, y / 4] for x, y in random_points(40, 2, seed)]
    b = [[x / 8 + 4, y / 8] for x, y in random_points(30, 2, seed + 1)]
    c = [[x * 1.5, y * 1.5 + 8] for x, y in random_points(30, 2, seed + 2)]
    return a + b + c + [a[0]] * 6 + [b[3]] * 3


@pytest.mark.parametrize("shuffled", [False, True])
def test_hierarchy_equals_the_plain_version(spark, make, shuffled):
    points, levels = blobs(3), [0.3, 0.8, 2.0] if shuffled else [0.3, 0.5, 0.8, 1.3, 3.5]
    options = {"limits": SHUFFLE_ONLY} if shuffled else {}
    found = density.density_hierarchy(make.points(points), levels, 4, 5, **options)
    rows, labels = plain_hierarchy(points, levels, 4, 5)
    assert {(r["level"], r["comp"], r["n"], r["chosen"]) for r in found.clusters.collect()} == rows
    assert {r["id"]: r["cluster"] for r in found.labels.collect()} == labels
    assert len(set(labels.values())) > 2


def test_forest_weights_and_cores(spark, make):
    points = random_points(70, 3, 5, step=0.5) + [[1.0, 1.0, 1.0]] * 5
    reach = density.reachability_forest(make.points(points), 100.0, 4)
    core = plain_cores(points, 4)
    got = {r["id"]: r["core"] for r in reach.places.df.collect()}
    assert all(math.isclose(got[i], core[i]) for i in got)
    first = [i for i, p in enumerate(points) if p not in points[:i]]
    assert sorted(got) == first
    want = kruskal([e for e in plain_links(points, 4) if e[0] in got and e[1] in got])
    weights = sorted(r["w"] for r in reach.forest.df.collect())
    assert len(weights) == len(first) - 1 and all(map(math.isclose, weights, sorted(w for *_, w in want)))


def test_cut_equals_dbscan_on_core_points(spark, make):
    eps, vertices = 0.6, make.points(blobs(11))
    found = density.density_hierarchy(vertices, [eps / 2, eps], 4, 1)
    sizes = {r["comp"]: r["n"] for r in found.clusters.where("level = 1").collect()}
    core = {i for i, c in enumerate(plain_cores(blobs(11), 4)) if c <= eps}
    want = {}
    for r in compare.dbscan(vertices, eps, 4).collect():
        if r["id"] in core:
            want[r["cluster"]] = want.get(r["cluster"], 0) + 1
    assert sizes == want


def test_undefined_points_few_points_and_no_points(spark, make):
    vertices = make.points([[0.0, 0.0], [0.1, 0.0], [float("nan"), 0.0], [float("inf"), 1.0], [0.0, 0.1]])
    found = density.density_hierarchy(vertices, [1.0], 3, 2)
    assert {r["id"]: r["cluster"] for r in found.labels.collect()} == {0: 0, 1: 0, 2: -1, 3: -1, 4: 0}
    lonely = density.density_hierarchy(vertices, [1.0, 2.0], 9, 2)
    assert lonely.clusters.count() == 0 and {r["cluster"] for r in lonely.labels.collect()} == {-1}
    empty = density.density_hierarchy(vertices.limit(0), [1.0], 3, 2)
    assert empty.clusters.count() == 0 and empty.labels.count() == 0
    with pytest.raises(ValueError):
        density.density_hierarchy(vertices, [2.0, 1.0])


def test_planar_form_makes_no_pairs(spark, make, monkeypatch):
    """Core points of large tables meet by fragments; no row per pair within the radius."""
    dim = 2
    rows = random_points(300, dim, 6, step=0.25) + [[40.0 + v for v in p] for p in random_points(150, dim, 7, step=0.5)]
    vertices = make.points(rows + rows[:40] + [[float("nan")] * dim])
    plain = density.reachability_forest(vertices, 6.0, 4)
    levels = density.density_hierarchy(vertices, [0.5, 1.0, 6.0], 4, 5)
    want = [set(map(tuple, f.collect())) for f in (plain.forest.df, levels.clusters, levels.labels)]
    noise = set(map(tuple, compare.dbscan(vertices, 0.8, 5).collect()))
    monkeypatch.setattr(density, "eps_join", None)
    monkeypatch.setattr(compare, "eps_join", None)
    planar = density.reachability_forest(vertices, 6.0, 4, planar_rows=0)
    levels = density.density_hierarchy(vertices, [0.5, 1.0, 6.0], 4, 5, planar_rows=0)
    assert [set(map(tuple, f.collect())) for f in (planar.forest.df, levels.clusters, levels.labels)] == want
    assert set(map(tuple, compare.dbscan(vertices, 0.8, 5, planar_rows=0).collect())) == noise
    assert len({c for _, c in noise}) > 2
