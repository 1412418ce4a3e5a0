"""Spectral embedding, mini-batch k-means and linkage under a graph, against plain versions."""

import hashlib

import numpy as np
import pytest

from grovelink.lookup import SHUFFLE_ONLY
from grovelink.operators import linkage, minibatch, spectral
from grovelink.operators.pairs import knn_symmetric
from grovelink.plans import catalog, graphs
from grovelink.schema import edges_to_arcs


def laplacian(n, edges):
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    d = w.sum(axis=1)
    scale = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    out = np.diag((d > 0).astype(float)) - scale[:, None] * w * scale[None, :]
    return out, d


@pytest.mark.parametrize("shuffled", [False, True])
def test_embedding_equals_a_dense_solver(spark, make, shuffled):
    rng = np.random.default_rng(2)
    group = np.repeat([0, 1, 2], [14, 13, 12])
    edges = [
        (a, b, float(rng.uniform(0.5, 1.5)))
        for a in range(39)
        for b in range(a + 1, 39)
        if rng.random() < (0.7 if group[a] == group[b] else 0.03)
    ]
    matrix, degree = laplacian(39, edges)
    options = {"limits": SHUFFLE_ONLY} if shuffled else {}
    found = spectral.spectral_embedding(edges_to_arcs(make.edges(edges)), make.ids(range(39)), 3, **options)
    assert np.allclose(found.values, np.linalg.eigvalsh(matrix)[:3], atol=1e-8)
    rows = sorted((r["id"], r["features"]) for r in found.vectors.collect())
    vectors = np.array([r[1] for r in rows]) * np.sqrt(degree)[:, None]
    assert np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-7)
    assert np.abs(matrix @ vectors - vectors * np.array(found.values)).max() < 1e-5


def test_embedding_tells_components_and_lone_vertices(spark, make):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (3, 4, 1.0), (7, 8, float("nan")), (0, 99, 1.0)]
    arcs = edges_to_arcs(make.edges(edges))
    found = spectral.spectral_embedding(arcs, make.ids(range(6)), 4)
    # three components, one of them a single vertex
    assert np.allclose(found.values[:3], 0, atol=1e-8) and found.values[3] > 0.5
    place = {r["id"]: np.array(r["features"][:3]) for r in found.vectors.collect()}
    assert np.allclose(place[0], place[1]) and np.allclose(place[1], place[2])
    assert np.allclose(place[3], place[4]) and not np.allclose(place[3], place[5])
    assert spectral.spectral_embedding(arcs, make.ids([]), 2).values == []


@pytest.mark.parametrize("n,shuffled", [(160, False), (50, True)])
def test_embedding_waits_for_slow_vectors(spark, make, n, shuffled):
    # a ring with few chords: restarts, eigenvalues close to each other
    rng = np.random.default_rng(8)
    pairs = {(i, i + 1) for i in range(n - 1)} | {(0, n - 1)}
    pairs |= {(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (12, 2)).tolist() if a != b}
    edges = [(a, b, 1.0) for a, b in sorted(pairs)]
    matrix, degree = laplacian(n, edges)
    options = {"limits": SHUFFLE_ONLY} if shuffled else {}
    found = spectral.spectral_embedding(edges_to_arcs(make.edges(edges)), make.ids(range(n)), 3, **options)
    assert np.allclose(found.values, np.linalg.eigvalsh(matrix)[:3], atol=1e-8) and max(found.residuals) <= 1e-6
    rows = sorted((r["id"], r["features"]) for r in found.vectors.collect())
    vectors = np.array([r[1] for r in rows]) * np.sqrt(degree)[:, None]
    assert np.abs(matrix @ vectors - vectors * np.array(found.values)).max() < 2e-6


def test_the_query_clusters_eigenvectors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, x, 0) for i, x in enumerate(rng.normal(size=(300, 12)).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    seen = []
    monkeypatch.setattr(catalog.compare, "kmeans", lambda vectors, k: seen.append(vectors) or vectors)
    catalog.QUERIES["spectral_lanczos"](spark, str(tmp_path))
    arcs = knn_symmetric(catalog.embeddings(spark, str(tmp_path)), 10).collect()
    matrix, degree = laplacian(300, [tuple(r) for r in arcs])
    found = sorted((r["id"], r["features"]) for r in seen[0].collect())
    vectors = np.array([r[1] for r in found]) * np.sqrt(degree)[:, None]
    values = np.linalg.eigvalsh(matrix)[:3]
    assert np.abs(matrix @ vectors - vectors * values).max() < 2e-6


def test_spectral_clusters_tell_groups_apart(spark, make):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    found = {r["id"]: r["cluster"] for r in spectral.spectral_clusters(make.points(points), 3, 12).collect()}
    groups = [{found[i] for i in range(g * 30, g * 30 + 30)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def draw(seed, *keys):
    text = "|".join(map(str, (seed, *keys)))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def test_batches_move_centres_as_the_plain_version(spark, make):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(200, 3)).round(3)
    points[150:] = points[:50]
    centres = points[sorted(range(200), key=lambda i: (draw(4, 0, i), i))[:5]].copy()
    weight = np.zeros(5)
    for step in range(1, 7):
        mine = [i for i in range(200) if draw(4, step, i) < 40 / 200]
        near = ((points[mine, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in set(near):
            x = points[mine][near == c]
            centres[c] = (centres[c] * weight[c] + x.sum(axis=0)) / (weight[c] + len(x))
            weight[c] += len(x)
    vertices = make.points(points)
    assert np.allclose(minibatch.minibatch_centres(vertices, 5, 40, 6, seed=4), centres)
    found = {r["id"]: r["cluster"] for r in minibatch.minibatch_kmeans(vertices, 5, 40, 6, seed=4).collect()}
    assert found == dict(enumerate(((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)))


def test_few_and_undefined_points(spark, make):
    vertices = make.points([[1.0, 2.0], [float("nan"), 0.0], [3.0, float("inf")], [5.0, 5.0]])
    found = {r["id"]: r["cluster"] for r in minibatch.minibatch_kmeans(vertices, 3, 10, 2).collect()}
    assert found[1] == found[2] == -1 and {found[0], found[3]} == {0, 1}
    assert minibatch.minibatch_kmeans(make.points([[1.0]]).limit(0), 3).count() == 0


def plain_linkage(points, edges, method):
    """One merge at a time, the lowest first; ties to the smaller ids."""
    members = {i: [i] for i in range(len(points))}
    near = {tuple(sorted(e[:2])): [e[2]] for e in edges}
    merges = []
    while near:
        def height(pair):
            if method == "average":
                return sum(near[pair]) / len(near[pair])
            a, b = (points[members[i]] for i in pair)
            weight = 2 * len(a) * len(b) / (len(a) + len(b))
            return np.sqrt(weight) * np.linalg.norm(a.mean(axis=0) - b.mean(axis=0))

        w, (a, b) = min((height(pair), pair) for pair in near)
        members[a] += members.pop(b)
        merges.append((a, b, w, len(members[a])))
        merged = {}
        for (s, d), ws in near.items():
            s, d = (a if i == b else i for i in (s, d))
            if s != d:
                merged.setdefault((min(s, d), max(s, d)), []).extend(ws)
        near = merged
    return merges


@pytest.mark.parametrize("method", ["ward", "average"])
@pytest.mark.parametrize("shuffled", [False, True])
def test_linkage_of_a_complete_graph(spark, make, method, shuffled):
    points = np.random.default_rng(8).normal(size=(20, 3))
    edges = [
        (a, b, float(np.linalg.norm(points[a] - points[b]))) for a in range(20) for b in range(a + 1, 20)
    ]
    options = {"limits": SHUFFLE_ONLY} if shuffled else {}
    got = linkage.connected_linkage(make.edges(edges), make.points(points), method, **options).collect()
    want = plain_linkage(points, edges, method)
    assert sorted((r["src"], r["dst"], r["n"]) for r in got) == sorted((a, b, n) for a, b, _, n in want)
    assert np.allclose(sorted(r["w"] for r in got), sorted(m[2] for m in want))


def test_linkage_with_ties_parts_and_undefined_points(spark, make):
    # two parts, equal steps along the first, a point without a place, an unknown vertex
    vertices = make.points([[0.0], [1.0], [2.0], [3.0], [10.0], [11.0], [float("nan")]])
    edges = make.edges([(0, 1, 1), (1, 2, 1), (3, 2, 1), (4, 5, 1), (5, 6, 1), (3, 77, 1), (0, 1, 5), (2, 2, 0)])
    got = [tuple(r) for r in linkage.connected_linkage(edges, vertices).orderBy("round", "src").collect()]
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(1, 0, 1, 2), (1, 4, 5, 2), (2, 2, 3, 2), (3, 0, 2, 4)]
    assert np.allclose([r[3] for r in got], [1, 1, 1, np.sqrt(2) * 2])
    merges = linkage.connected_linkage(edges, vertices)
    cut = {r["id"]: r["comp"] for r in graphs.cut_clusters(merges.select("src", "dst", "w"), vertices, 2).collect()}
    assert cut == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}
    assert linkage.connected_linkage(edges.limit(0), vertices).count() == 0
    assert linkage.connected_linkage(edges, vertices, "average", max_rounds=1).where("round > 1").count() == 0
