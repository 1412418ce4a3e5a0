"""Plain-Python answers for small inputs."""

import math
import random


def kruskal(edges):
    """Forest under (w, src, dst) of canonical edges."""
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    out = []
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b, w))
    return sorted(out)


def components(vertices, edges):
    label = {v: v for v in vertices}
    for a, b, *_ in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b, *_ in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def euclidean(p, q):
    total = 0.0
    for x, y in zip(p, q):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def complete(points, distance=euclidean):
    return [
        (i, j, distance(points[i], points[j]))
        for i in range(len(points))
        for j in range(i + 1, len(points))
    ]


def knn(points, k):
    out = []
    for i, p in enumerate(points):
        near = sorted((euclidean(p, q), j) for j, q in enumerate(points) if j != i)[:k]
        out += [(i, j, d) for d, j in near]
    return sorted(out)


def path_min(links):
    lead = {}
    for v in links:
        seen, u = [], v
        while u not in seen:
            seen.append(u)
            u = links.get(u, u)
        lead[v] = min(seen)
    return lead


def linkage(arcs, vertices, stop=3, limit=40):
    """Rounds of (labels, merges) with ties by (w, lo, hi, src) of the original arcs."""
    label = {v: v for v in vertices}
    rounds, merges = [], {}
    while len(rounds) < limit:
        live = set(label.values())
        best = {}
        for a, b, w in arcs:
            s, d = label[a], label[b]
            if s != d:
                key = (w, min(a, b), max(a, b), a)
                if s not in best or key < best[s][0]:
                    best[s] = (key, d)
        if len(live) <= stop or not best:
            break
        links = {v: best[v][1] if v in best else v for v in live}
        lead = path_min(links)
        for v in live:
            if lead[v] != v:
                merges[v] = (lead[v], links[v], len(rounds) + 1)
        if all(lead[v] == v for v in live):
            break
        label = {v: lead[label[v]] for v in label}
        rounds.append(dict(label))
    for v in vertices:
        merges.setdefault(v, (v, v, None))
    return rounds, merges


def random_points(n, dim, seed, step=0.0):
    rng = random.Random(seed)
    rows = [[rng.uniform(0, 10) for _ in range(dim)] for _ in range(n)]
    if step:
        rows = [[round(x / step) * step for x in r] for r in rows]
    return rows


def random_edges(n, m, seed, weights=50):
    rng = random.Random(seed)
    seen = {}
    while len(seen) < m:
        a, b = rng.sample(range(n), 2)
        seen[min(a, b), max(a, b)] = float(rng.randint(1, weights))
    return [(a, b, w) for (a, b), w in seen.items()]
