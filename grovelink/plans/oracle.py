"""The catalog's queries in plain SQL, written independently of the Spark code.

Iterative results are unrolled into a fixed number of rounds, with recursion
only for following pointers. Rounds after the last useful one change nothing.
"""

from __future__ import annotations

from ..functions.weights import ZIPF_TABLE

P1 = "SELECT s_suppkey AS id, s_acctbal AS x FROM supplier"
P2 = "SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey * 400 AS DOUBLE) AS y FROM supplier"
C1 = "SELECT c_custkey AS id, c_acctbal AS x FROM customer"
C2 = "SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey * 400 AS DOUBLE) AS y FROM customer"
PE = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, CAST(label AS DOUBLE) AS label FROM embeddings"
ROWS = """SELECT CASE WHEN l_linenumber % 2 = 1 THEN l_partkey ELSE l_suppkey + 1000000000 END AS src,
  CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey + 1000000000 ELSE l_partkey END AS dst,
  l_extendedprice AS w FROM lineitem"""
EL = """SELECT l_partkey AS src, l_suppkey + 1000000000 AS dst, min(l_extendedprice) AS w
  FROM lineitem GROUP BY 1, 2"""
D2 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
DE = "list_distance(a.f, b.f)"
BOTH = "SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e"


LINKS = 14  # linkage rounds to unroll
WARD_ROUNDS = 30


def _with(*ctes: tuple[str, str], recursive: bool = False) -> str:
    body = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body} "


def _u(seed: str, *keys: str) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', {seed}, {text})), 1, 8) AS UBIGINT) / CAST(4294967296 AS DOUBLE))"


def _lit(value) -> str:
    return f"'{value}'"


PAIR = ("least(src, dst)", "greatest(src, dst)")


def _pairs(points: str, distance: str, where: str = "TRUE") -> str:
    return f"SELECT a.id AS src, b.id AS dst, {distance} AS w FROM ({points}) a JOIN ({points}) b ON a.id < b.id WHERE {where}"


def _knn(points: str, distance: str, k: int) -> str:
    return f"""SELECT src, dst, w FROM (SELECT a.id AS src, b.id AS dst, {distance} AS w
      FROM ({points}) a JOIN ({points}) b ON a.id <> b.id)
      QUALIFY row_number() OVER (PARTITION BY src ORDER BY w, dst) <= {k}"""


def _components(vertices: str, edges: str) -> str:
    """CTE list (v, ed, reach, comps) of component = smallest reachable id."""
    return f"""v AS MATERIALIZED ({vertices}),
    ed AS MATERIALIZED (SELECT src, dst FROM ({edges}) UNION SELECT dst, src FROM ({edges})),
    reach AS (SELECT id, id AS cur FROM v UNION SELECT r.id, e.dst FROM reach r JOIN ed e ON r.cur = e.src),
    comps AS MATERIALIZED (SELECT id, min(cur) AS comp FROM reach GROUP BY id)"""


def _best(source: str) -> str:
    return f"""SELECT src AS id, arg_min(dst, row(w, dst)) AS nbr, min(w) AS w
      FROM ({source}) GROUP BY src"""


WALK = """walk AS (SELECT id, id AS cur FROM best UNION
      SELECT k.id, b.nbr FROM walk k JOIN best b ON k.cur = b.id),
    lead AS MATERIALIZED (SELECT id, min(cur) AS leader FROM walk GROUP BY id)"""


def _connected_linkage(height: str, rounds: int) -> str:
    """Merges of mutual best neighbours under the suppliers' neighbour graph, rounds unrolled."""
    parts = [
        f"near AS MATERIALIZED ({_knn(P2, D2, 5)})",
        """l0 AS MATERIALIZED (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(w) AS total, 1 AS links
          FROM near GROUP BY 1, 2)""",
        f"c0 AS MATERIALIZED (SELECT id, 1 AS n, x, y FROM ({P2}))",
    ]
    for r in range(1, rounds + 1):
        p = r - 1
        parts += [
            f"""w{r} AS MATERIALIZED (SELECT l.src, l.dst, {height} AS w, a.n + b.n AS n FROM l{p} l
              JOIN c{p} a ON l.src = a.id JOIN c{p} b ON l.dst = b.id)""",
            f"""b{r} AS MATERIALIZED (SELECT id, min(row(w, src, dst)) AS first FROM (SELECT src AS id, * FROM w{r}
              UNION ALL SELECT dst AS id, * FROM w{r}) GROUP BY id)""",
            f"""m{r} AS MATERIALIZED (SELECT w.src, w.dst, w.w, w.n FROM w{r} w JOIN b{r} a ON w.src = a.id
              JOIN b{r} b ON w.dst = b.id WHERE a.first = b.first AND a.first = row(w.w, w.src, w.dst))""",
            f"""l{r} AS MATERIALIZED (SELECT least(s, d) AS src, greatest(s, d) AS dst, sum(total) AS total, sum(links) AS links
              FROM (SELECT coalesce(a.src, l.src) AS s, coalesce(b.src, l.dst) AS d, total, links FROM l{p} l
              LEFT JOIN m{r} a ON l.src = a.dst LEFT JOIN m{r} b ON l.dst = b.dst) WHERE s <> d GROUP BY 1, 2)""",
            f"""c{r} AS MATERIALIZED (SELECT coalesce(m.src, c.id) AS id, sum(c.n) AS n, sum(x) AS x, sum(y) AS y
              FROM c{p} c LEFT JOIN m{r} m ON c.id = m.dst GROUP BY 1)""",
        ]
    union = " UNION ALL ".join(
        f"SELECT CAST({r} AS INTEGER) AS round, src, dst, round(w, 4) AS w, CAST(n AS BIGINT) AS n FROM m{r}"
        for r in range(1, rounds + 1)
    )
    return f"WITH {', '.join(parts)} {union}"


def _minibatch(points: str, k: int, batch: int, steps: int, seed: int) -> str:
    near = "arg_min(c.c, row((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.c))"
    first = _u(_lit(seed), "0", "id")
    parts = [
        f"p AS MATERIALIZED ({points})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {first}, id) - 1 AS c, x, y, 0 AS n FROM p "
        f"QUALIFY row_number() OVER (ORDER BY {first}, id) <= {k})",
    ]
    for t in range(1, steps + 1):
        parts += [
            f"""a{t} AS MATERIALIZED (SELECT p.id, any_value(p.x) AS x, any_value(p.y) AS y, {near} AS c
              FROM p, c{t - 1} c WHERE {_u(_lit(seed), str(t), 'p.id')} < CAST({batch} AS DOUBLE) / (SELECT count(*) FROM p)
              GROUP BY p.id)""",
            f"""c{t} AS MATERIALIZED (SELECT c.c, CASE WHEN m.n IS NULL THEN c.x ELSE (c.x * c.n + m.x) / (c.n + m.n) END AS x,
              CASE WHEN m.n IS NULL THEN c.y ELSE (c.y * c.n + m.y) / (c.n + m.n) END AS y, c.n + coalesce(m.n, 0) AS n
              FROM c{t - 1} c LEFT JOIN (SELECT c, sum(x) AS x, sum(y) AS y, count(*) AS n FROM a{t} GROUP BY c) m ON c.c = m.c)""",
        ]
    return f"WITH {', '.join(parts)} SELECT p.id, CAST({near} AS INTEGER) AS cluster FROM p, c{steps} c GROUP BY p.id"


def _density(points: str, distance: str, levels: tuple[float, ...], k: int, size: int) -> str:
    """CTE list ending in chosen and p: density branches level by level, then from the loosest inwards."""
    top = len(levels) - 1
    gaps = [1 / a - 1 / b for a, b in zip(levels, levels[1:])] + [1 / levels[-1]]
    close = f"abs(a.x - b.x) <= {levels[-1]} AND {distance} <= CAST({levels[-1]} AS DOUBLE)"
    parts = [
        f"p AS MATERIALIZED ({points})",
        f"near AS MATERIALIZED ({_pairs(points, distance, close)})",
        "ar AS MATERIALIZED (SELECT src, dst, w FROM near UNION ALL SELECT dst, src, w FROM near)",
        f"""core AS MATERIALIZED (SELECT src AS id, w AS core FROM ar
          QUALIFY row_number() OVER (PARTITION BY src ORDER BY w) = {k - 1})""",
        """mr AS MATERIALIZED (SELECT src, dst, greatest(w, a.core, b.core) AS w FROM ar
          JOIN core a ON src = a.id JOIN core b ON dst = b.id)""",
    ]
    for i, eps in enumerate(levels):
        parts += [
            f"""r{i} AS (SELECT id, id AS cur FROM core WHERE core <= {eps} UNION
              SELECT r.id, e.dst FROM r{i} r JOIN mr e ON r.cur = e.src WHERE e.w <= {eps})""",
            f"q{i} AS MATERIALIZED (SELECT id, min(cur) AS comp FROM r{i} GROUP BY id)",
            f"z{i} AS MATERIALIZED (SELECT comp, count(*) AS n FROM q{i} GROUP BY comp HAVING count(*) >= {size})",
        ]
        kids = "SELECT NULL AS up, 0 AS kids, CAST(0 AS DOUBLE) AS mass, CAST(0 AS DOUBLE) AS sub, CAST(0 AS DOUBLE) AS best"
        if i:
            kids = f"""SELECT q.comp AS up, count(*) AS kids, max(s.mass) AS mass, max(s.sub) AS sub,
              sum(greatest(s.mass, s.sub)) AS best FROM s{i - 1} s JOIN q{i} q ON s.comp = q.id GROUP BY 1"""
        parts.append(
            f"""s{i} AS MATERIALIZED (SELECT z.comp, z.n, coalesce(k.kids, 0) AS kids,
              CASE WHEN k.kids = 1 THEN k.mass ELSE 0 END + z.n * CAST({gaps[i]!r} AS DOUBLE) AS mass,
              CASE WHEN k.kids = 1 THEN k.sub ELSE coalesce(k.best, 0) END AS sub
              FROM z{i} z LEFT JOIN ({kids}) k ON z.comp = k.up)"""
        )
    parts.append(f"t{top} AS MATERIALIZED (SELECT comp, n, kids, mass >= sub AS chosen, mass >= sub AS taken FROM s{top})")
    for i in range(top - 1, -1, -1):
        mine = "u.kids > 1 AND NOT u.taken AND s.mass >= s.sub"
        parts.append(
            f"""t{i} AS MATERIALIZED (SELECT s.comp, s.n, s.kids, {mine} AS chosen, u.taken OR ({mine}) AS taken
              FROM s{i} s JOIN q{i + 1} q ON s.comp = q.id JOIN t{i + 1} u ON q.comp = u.comp)"""
        )
    labels = " UNION ALL ".join(
        f"SELECT q.id, q.comp FROM q{i} q JOIN t{i} t ON q.comp = t.comp WHERE t.chosen" for i in range(top + 1)
    )
    return "WITH RECURSIVE " + ", ".join([*parts, f"chosen AS MATERIALIZED ({labels})"])


def _density_levels(levels: int) -> str:
    return " UNION ALL ".join(f" SELECT CAST({i} AS INTEGER) AS level, comp, n, chosen FROM t{i}" for i in range(levels))


def _forest(edges: str, rounds: int) -> str:
    """CTE list ending in forest(src, dst, w): every group takes its first edge, rounds times."""
    parts = [
        f"e0 AS MATERIALIZED ({edges})",
        "t0 AS MATERIALIZED (SELECT DISTINCT id, id AS g FROM (SELECT src AS id FROM e0 UNION SELECT dst FROM e0))",
    ]
    for r in range(1, rounds + 1):
        p = r - 1
        parts += [
            f"""x{r} AS MATERIALIZED (SELECT e.src, e.dst, e.w, a.g AS ga, b.g AS gb FROM e0 e
              JOIN t{p} a ON e.src = a.id JOIN t{p} b ON e.dst = b.id WHERE a.g <> b.g)""",
            f"""b{r} AS MATERIALIZED (SELECT g, arg_min(h, row(w, src, dst)) AS h,
              arg_min(src, row(w, src, dst)) AS src, arg_min(dst, row(w, src, dst)) AS dst, min(w) AS w
              FROM (SELECT ga AS g, gb AS h, src, dst, w FROM x{r} UNION ALL
                    SELECT gb, ga, src, dst, w FROM x{r}) GROUP BY g)""",
            f"""k{r} AS (SELECT g, g AS cur FROM b{r} UNION
              SELECT k.g, b.h FROM k{r} k JOIN b{r} b ON k.cur = b.g)""",
            # a path ends in two groups that chose each other; the smaller one names the union
            f"""m{r} AS MATERIALIZED (SELECT k.g, min(k.cur) AS root FROM k{r} k JOIN b{r} b ON k.cur = b.g
              JOIN b{r} c ON b.h = c.g WHERE c.h = b.g GROUP BY k.g)""",
            f"""t{r} AS MATERIALIZED (SELECT t.id, coalesce(m.root, t.g) AS g FROM t{p} t
              LEFT JOIN m{r} m ON t.g = m.g)""",
        ]
    union = " UNION ".join(f"SELECT src, dst, w FROM b{r}" for r in range(1, rounds + 1))
    parts.append(f"forest AS MATERIALIZED ({union})")
    return ", ".join(parts)


def _linkage(arcs: str, vertices: str, rounds: int, stop: int) -> str:
    """CTE list of linkage rounds: l<r>(run, id, label), n<r> (best neighbour), c<r> (changed runs)."""
    parts = [
        f"a0 AS MATERIALIZED ({arcs})",
        f"l0 AS MATERIALIZED (SELECT run, id, id AS label FROM ({vertices}))",
    ]
    for r in range(1, rounds + 1):
        p = r - 1
        parts += [
            f"""x{r} AS MATERIALIZED (SELECT a.run, s.label AS s, d.label AS d, a.w,
              least(a.src, a.dst) AS lo, greatest(a.src, a.dst) AS hi, a.src AS o FROM a0 a
              JOIN l{p} s ON a.run = s.run AND a.src = s.id JOIN l{p} d ON a.run = d.run AND a.dst = d.id
              WHERE s.label <> d.label AND a.run IN
                (SELECT run FROM l{p} GROUP BY run HAVING count(DISTINCT label) > {stop}))""",
            f"""n{r} AS MATERIALIZED (SELECT run, s, arg_min(d, row(w, lo, hi, o)) AS nb
              FROM x{r} GROUP BY run, s)""",
            f"""k{r} AS (SELECT run, s, s AS cur FROM n{r} UNION
              SELECT k.run, k.s, n.nb FROM k{r} k JOIN n{r} n ON k.run = n.run AND k.cur = n.s)""",
            f"d{r} AS MATERIALIZED (SELECT run, s, min(cur) AS leader FROM k{r} GROUP BY run, s)",
            f"""l{r} AS MATERIALIZED (SELECT l.run, l.id, coalesce(d.leader, l.label) AS label FROM l{p} l
              LEFT JOIN d{r} d ON l.run = d.run AND l.label = d.s)""",
            f"""c{r} AS MATERIALIZED (SELECT DISTINCT a.run FROM l{p} a JOIN l{r} b
              ON a.run = b.run AND a.id = b.id WHERE a.label <> b.label)""",
        ]
    return ", ".join(parts)


def _group_linkage(arcs: str, vertices: str, rounds: int, stop: int) -> str:
    """Like _linkage for one run, but the leader is the smallest id of the whole group."""
    parts = [
        f"a0 AS MATERIALIZED ({arcs})",
        f"l0 AS MATERIALIZED (SELECT 0 AS run, id, id AS label FROM ({vertices}))",
    ]
    for r in range(1, rounds + 1):
        p = r - 1
        parts += [
            f"""n{r} AS MATERIALIZED (SELECT s.label AS s, arg_min(d.label,
              row(a.w, least(a.src, a.dst), greatest(a.src, a.dst), a.src)) AS nb FROM a0 a
              JOIN l{p} s ON a.src = s.id JOIN l{p} d ON a.dst = d.id WHERE s.label <> d.label
              AND (SELECT count(DISTINCT label) FROM l{p}) > {stop} GROUP BY s.label)""",
            f"y{r} AS MATERIALIZED (SELECT s AS u, nb AS v FROM n{r} UNION SELECT nb, s FROM n{r})",
            f"""k{r} AS (SELECT DISTINCT u AS s, u AS cur FROM y{r} UNION
              SELECT k.s, y.v FROM k{r} k JOIN y{r} y ON k.cur = y.u)""",
            f"d{r} AS MATERIALIZED (SELECT s, min(cur) AS leader FROM k{r} GROUP BY s)",
            f"""l{r} AS MATERIALIZED (SELECT 0 AS run, l.id, coalesce(d.leader, l.label) AS label
              FROM l{p} l LEFT JOIN d{r} d ON l.label = d.s)""",
            f"""c{r} AS MATERIALIZED (SELECT DISTINCT a.run FROM l{p} a JOIN l{r} b
              ON a.id = b.id WHERE a.label <> b.label)""",
        ]
    return ", ".join(parts)


def _labels(rounds: int) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({r} AS INTEGER) AS round, id, label FROM l{r} WHERE run IN (SELECT run FROM c{r})"
        for r in range(1, rounds + 1)
    )


def _merges(rounds: int, extra: str = "") -> str:
    parts = [
        f"""SELECT p.run, p.id, l.label AS leader, n.nb AS parent, CAST({r} AS INTEGER) AS round
          FROM l{r - 1} p JOIN l{r} l ON p.run = l.run AND p.id = l.id
          JOIN n{r} n ON n.run = p.run AND n.s = p.id WHERE p.label = p.id AND l.label <> l.id"""
        for r in range(1, rounds + 1)
    ]
    parts.append(f"SELECT run, id, label, label, NULL FROM l{rounds} WHERE label = id")
    return " UNION ALL ".join(parts)


def _bounds(edges: str, beta: float, alpha: float, seed) -> str:
    """CTE list (top, nb, raw, bounds(bucket, lo, hi)) of jittered geometric buckets."""
    jitter = f"(1.0::DOUBLE + (2.0::DOUBLE * {_u(_lit(seed), 'i')} - 1.0::DOUBLE) * {alpha}::DOUBLE)"
    return f"""top AS MATERIALIZED (SELECT max(w) AS w FROM ({edges})),
    nb AS MATERIALIZED (SELECT w, CASE WHEN w <= 1 THEN 1 ELSE greatest(1,
      CAST(ceil(ln(w) / ln(1.0::DOUBLE + {beta}::DOUBLE)) AS INTEGER)) END AS n FROM top),
    raw AS MATERIALIZED (SELECT i, CASE WHEN i < n - 1 THEN pow(1.0::DOUBLE + {beta}::DOUBLE, i) * {jitter}
      ELSE w + 1e-5::DOUBLE END AS h FROM nb, range(0, n) t(i)),
    his AS MATERIALIZED (SELECT i, max(h) OVER (ORDER BY i) AS hi FROM raw),
    bounds AS MATERIALIZED (SELECT CAST(i + 1 AS INTEGER) AS bucket,
      coalesce(lag(hi) OVER (ORDER BY i), 0.0::DOUBLE) AS lo, hi FROM his)"""


def _shape(kind: str) -> str:
    pi = "pi()"
    x, y = {
        "circle": (
            f"cos(i * (2 * {pi} / size)) * r + cx",
            f"sin(i * (2 * {pi} / size)) * r + cy",
        ),
        "hline": ("x0 + i * ((x1 - x0) / size)", "cy"),
        "vline": ("cx", "y0 + i * ((y1 - y0) / size)"),
    }[kind]
    return f"""WITH p AS ({C2}), b AS (SELECT count(*) AS n, max(id) AS last, min(x) AS x0, max(x) AS x1,
      min(y) AS y0, max(y) AS y1 FROM p),
    s AS (SELECT *, CAST(ceil(n * 0.1::DOUBLE) AS BIGINT) AS size, (x1 + x0) / 2 AS cx, (y1 + y0) / 2 AS cy,
      least(x1 - x0, y1 - y0) * 0.7::DOUBLE / 2 AS r FROM b)
    SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM p UNION ALL
    SELECT last + 1 + i, round({x}, 6), round({y}, 6) FROM s, range(0, size) t(i)"""


SUMMARY = """CAST(count(*) AS BIGINT) AS num_edges, round(min(w), 6) AS min_edge_weight,
  round(max(w), 6) AS max_edge_weight, round(avg(w), 6) AS mean_edge_weight,
  round(median(w), 6) AS median_edge_weight"""
ZETA = "(pi() * pi() / 6)"
PERTURB = "100.0::DOUBLE * greatest(w + (2.0::DOUBLE * {u} - 1.0::DOUBLE) * 0.05::DOUBLE * w, 0.0::DOUBLE)"
ZIPF = f"""SELECT src, dst, CASE WHEN k <= {ZIPF_TABLE} THEN CAST(k AS DOUBLE)
  ELSE greatest(ceil(1 / ({ZETA} * (1 - u)) - 0.5::DOUBLE), {ZIPF_TABLE + 1}) END AS w
  FROM (SELECT src, dst, u, (SELECT count(*) FROM cdf WHERE c < u) + 1 AS k FROM drawn)"""
CDF = f"""SELECT k, sum(1.0::DOUBLE / (k * k)) OVER (ORDER BY k) / {ZETA} AS c
  FROM range(1, {ZIPF_TABLE + 1}) t(k)"""


def oracle_sql() -> dict[str, str]:
    edges = _with(("e", EL))
    arcs = edges + f", ar AS MATERIALIZED ({BOTH}) "
    rounds_run = f"SELECT run, id FROM (SELECT id FROM ({P2})) , range(0, 10) t(run)"
    best = f"WITH RECURSIVE e AS MATERIALIZED ({EL}), ar AS MATERIALIZED ({BOTH}), best AS MATERIALIZED ({_best('SELECT * FROM ar')}), "
    forest_out = "SELECT src, dst, round(w, 6) AS w FROM forest"
    rec = "WITH RECURSIVE "
    comp_e = rec + _components(f"SELECT id FROM ({PE})", _pairs(PE, DE, f"{DE} <= 1.1"))
    comp_c = rec + _components(f"SELECT id FROM ({C2})", _pairs(C2, D2, f"abs(a.x - b.x) <= 60 AND {D2} <= 60"))
    full = f"SELECT 0 AS run, src, dst, w FROM ({_pairs(P2, D2)}) UNION ALL SELECT 0, dst, src, w FROM ({_pairs(P2, D2)})"
    single = f"SELECT 0 AS run, id FROM ({P2})"
    shifted = f"SELECT run, src, dst, {PERTURB.format(u=_u('CAST(run AS VARCHAR)', *PAIR))} AS w FROM ({_pairs(P2, D2)}), range(0, 10) t(run)"
    one_shift = f"SELECT src, dst, {PERTURB.format(u=_u(_lit(9), *PAIR))} AS w FROM ({_pairs(P2, D2)})"
    embed_arcs = f"SELECT 0 AS run, src, dst, w FROM ({_knn(PE, DE, 5)})"
    drawn = f"SELECT src, dst, {_u(_lit(5), *PAIR)} AS u FROM e"
    gauss_u = {n: _u(_lit(f"5-{n}"), *PAIR) for n in ("mean", "radius", "angle")}
    edge_rounds = 14
    sql = {
        "read_polygon_json": f"""WITH p AS ({P2}), n AS (SELECT id // 50 AS g, id % 50 AS i, x, y FROM p),
          s AS (SELECT a.g, a.i AS src, b.i AS dst, {D2} AS w FROM n a JOIN n b ON a.g = b.g AND b.i = a.i + 1)
          SELECT CAST(g AS BIGINT) AS graph, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst,
          round(w, 6) AS w FROM s""",
        "read_edge_tsv": f"SELECT src, dst, round(w, 6) AS w FROM ({EL})",
        "read_edge_tsv_drawn": edges + f", drawn AS MATERIALIZED ({drawn}), cdf AS MATERIALIZED ({CDF}) {ZIPF}",
        "read_edge_csv": f"""WITH t AS (SELECT 'v' || src AS a, 'v' || dst AS b, w FROM ({EL})),
          o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS w FROM t GROUP BY 1, 2),
          ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM
            (SELECT a AS name FROM o UNION SELECT b FROM o))
          SELECT x.id AS src, y.id AS dst, round(w, 6) AS w, a, b FROM o
          JOIN ids x ON a = x.name JOIN ids y ON b = y.name""",
        "read_points_csv": f"SELECT round(x, 6) AS x, round(y, 6) AS y, count(*) AS n FROM ({P2}) GROUP BY 1, 2",
        "read_csv_columns": """SELECT round(p_retailprice, 6) AS x, CAST(p_size AS DOUBLE) AS y,
          count(*) AS n FROM part GROUP BY 1, 2""",
        "build_graph": f"""WITH s AS (SELECT {SUMMARY} FROM ({_pairs(C2, D2, f'abs(a.x - b.x) <= 60 AND {D2} <= 60')}))
          SELECT (SELECT count(*) FROM customer) AS num_vertices, num_edges, CAST(2 AS INTEGER) AS num_features,
          'f1,f2' AS feature_names, min_edge_weight, max_edge_weight, mean_edge_weight, median_edge_weight FROM s""",
        "export_edge_map": f"SELECT src, dst, round(w, 6) AS w FROM ({EL})",
        "first_rows": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 100",
        "assign_ids": """SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS id, c_custkey
          FROM customer""",
        "make_vertices": """SELECT p_partkey AS id, p_retailprice AS f1, CAST(p_size * 2 AS DOUBLE) AS f2,
          CAST(p_size AS DOUBLE) AS label FROM part""",
        "edge_dedup": f"""SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(w), 6) AS w
          FROM ({ROWS}) WHERE src <> dst GROUP BY 1, 2""",
        "edges_to_arcs": arcs + "SELECT src, dst, round(w, 6) AS w FROM ar",
        "adjacency": arcs + "SELECT src, dst, round(w, 6) AS w FROM ar",
        "distinct_vertices": f"SELECT src AS id FROM ({ROWS}) UNION SELECT dst FROM ({ROWS})",
        "all_pairs_euclidean": f"SELECT src, dst, round(w, 6) AS w FROM ({_pairs(PE, DE)})",
        "all_pairs_manhattan": "SELECT src, dst, round(w, 6) AS w FROM ({})".format(
            _pairs(PE, "list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))")
        ),
        "all_pairs_cosine": f"SELECT src, dst, round(w, 6) AS w FROM ({_pairs(PE, 'list_cosine_distance(a.f, b.f)')})",
        "threshold_edges": f"SELECT src, dst, round(w, 6) AS w FROM ({_pairs(PE, DE, f'{DE} <= 1.2')})",
        "max_edges": f"""SELECT src, dst, round(w, 6) AS w FROM ({_pairs(PE, DE, f'{DE} <= 1.3')})
          ORDER BY src, dst LIMIT 1000""",
        "eps_join_1d": f"SELECT src, dst, round(w, 6) AS w FROM ({_pairs(C1, 'abs(a.x - b.x)', 'abs(a.x - b.x) <= 0.75::DOUBLE')})",
        "eps_join_2d": f"SELECT src, dst, round(w, 6) AS w FROM ({_pairs(C2, D2, f'abs(a.x - b.x) <= 60 AND {D2} <= 60')})",
        "knn_join": f"SELECT src, dst, round(w, 6) AS w FROM ({_knn(PE, DE, 5)})",
        "knn_grid": f"SELECT src, dst, round(w, 6) AS w FROM ({_knn(C2, D2, 5)})",
        "knn_cosine": f"SELECT src, dst, round(w, 6) AS w FROM ({_knn(PE, 'list_cosine_distance(a.f, b.f)', 3)})",
        "knn_symmetric": f"""WITH k AS MATERIALIZED ({_knn(PE, DE, 3)})
          SELECT src, dst, CAST(count(*) AS DOUBLE) * 0.5::DOUBLE AS w FROM
          (SELECT src, dst FROM k UNION ALL SELECT dst, src FROM k) GROUP BY src, dst""",
        "k_nearest_shuffled": f"""WITH e AS MATERIALIZED ({EL}), {_bounds('SELECT * FROM e', 0.2, 0.1, 3)},
          q AS MATERIALIZED (SELECT src, dst, CAST((SELECT count(*) FROM bounds WHERE hi <= e.w) + 1 AS DOUBLE) AS w FROM e),
          ar AS (SELECT * FROM q UNION ALL SELECT dst, src, w FROM q)
          SELECT src, dst, w FROM ar QUALIFY row_number() OVER
          (PARTITION BY src ORDER BY w, {_u(_lit(11), 'src', 'dst')}, dst) <= 3""",
        "edges_between": edges + """SELECT src, dst, round(w, 6) AS w FROM e
          WHERE (src % 3 = 0 AND dst % 3 = 1) OR (src % 3 = 1 AND dst % 3 = 0)""",
        "remove_edges": edges + "SELECT src, dst, round(w, 6) AS w FROM e WHERE w <= 30000",
        "forest_in_cluster": rec
        + _components(f"SELECT id FROM ({P1})", _pairs(P1, "abs(a.x - b.x)", "abs(a.x - b.x) <= 100"))
        + ", "
        + _forest(_pairs(P1, "abs(a.x - b.x)"), 10)
        + " SELECT src, dst, round(w, 6) AS w FROM forest WHERE src IN (SELECT id FROM comps WHERE comp = 0)",
        "attach_label": comp_e + f" SELECT c.id, comp, label FROM comps c JOIN ({PE}) p ON c.id = p.id",
        "best_neighbour": best[:-2] + " SELECT id, nbr, round(w, 6) AS w FROM best",
        "leaders_path_min": best + WALK + " SELECT id, leader FROM lead",
        "leaders_component_min": rec
        + f"e AS MATERIALIZED ({EL}), best AS MATERIALIZED ({_best(BOTH)}), "
        + _components("SELECT id FROM best", "SELECT id AS src, nbr AS dst FROM best")
        + " SELECT id, comp AS leader FROM comps",
        "relabel": best + WALK + """ SELECT s.leader AS src, d.leader AS dst, count(*) AS n,
          round(min(w), 6) AS w FROM ar
          JOIN lead s ON ar.src = s.id JOIN lead d ON ar.dst = d.id WHERE s.leader <> d.leader GROUP BY 1, 2""",
        "contract_once": best + WALK + """ SELECT s.leader AS src, d.leader AS dst, round(min(w), 6) AS w FROM ar
          JOIN lead s ON ar.src = s.id JOIN lead d ON ar.dst = d.id WHERE s.leader <> d.leader GROUP BY 1, 2""",
        "graph_summary": f"""WITH s AS (SELECT {SUMMARY} FROM ({_pairs(PE, DE, f'{DE} <= 1.2')}))
          SELECT (SELECT count(*) FROM embeddings) AS num_vertices, num_edges, CAST(1 AS INTEGER) AS num_features,
          'embedding' AS feature_names, min_edge_weight, max_edge_weight, mean_edge_weight, median_edge_weight FROM s""",
        "edge_count": edges + "SELECT count(*) AS n FROM e",
        "max_weight": edges + "SELECT max(w) AS w FROM e",
        "bounding_box": f"""SELECT min(x) AS min_0, max(x) AS max_0, min(y) AS min_1, max(y) AS max_1 FROM ({C2})""",
        "exact_median": edges + "SELECT median(w) AS median FROM e",
        "bucket_histogram": f"""WITH e AS MATERIALIZED ({EL}), {_bounds('SELECT * FROM e', 0.2, 0.1, 3)}
          SELECT bucket, round(lo, 6) AS lo, round(hi, 6) AS hi,
          (SELECT count(*) FROM e WHERE w >= lo AND w < hi) AS n FROM bounds""",
        "run_differences": """WITH r AS (SELECT l_orderkey AS id, max(l_suppkey) AS a, min(l_suppkey) AS b,
            max(l_partkey) AS c FROM lineitem GROUP BY 1),
          t AS (SELECT 0 AS run, id, a AS val FROM r UNION ALL SELECT 1, id, b FROM r UNION ALL SELECT 2, id, c FROM r)
          SELECT p.run AS run_a, q.run AS run_b, CAST(count(*) FILTER (p.val <> q.val) AS BIGINT) AS diff
          FROM t p JOIN t q ON p.id = q.id GROUP BY 1, 2""",
        "label_crosstab": comp_e + f""" SELECT comp, label, count(*) AS n FROM comps c JOIN ({PE}) p ON c.id = p.id
          GROUP BY 1, 2""",
        "cluster_sizes": comp_e + " SELECT comp, count(*) AS n FROM comps GROUP BY comp",
        "bucket_msf": rec
        + _forest(f"SELECT src * 8 + dst % 4 AS src, dst * 8 + dst % 4 AS dst, w FROM ({EL})", edge_rounds)
        + """ SELECT e.src // 8 AS src, e.dst // 8 AS dst, round(e.w, 6) AS w,
          CAST(f.src IS NOT NULL AS INTEGER) AS kept FROM e0 e LEFT JOIN forest f ON e.src = f.src AND e.dst = f.dst""",
        "column_distances": f"""SELECT a.id, round({DE}, 6) AS euclidean, round(list_cosine_distance(a.f, b.f), 6) AS cosine,
          round(list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2]))), 6) AS manhattan
          FROM ({PE}) a JOIN ({PE}) b ON b.id = a.id + 1""",
        "removed_edges": rec
        + _forest(f"SELECT src * 8 + dst % 4 AS src, dst * 8 + dst % 4 AS dst, w FROM ({EL})", edge_rounds)
        + """ SELECT e.src // 8 AS src, e.dst // 8 AS dst, round(e.w, 6) AS w
          FROM e0 e ANTI JOIN forest f ON e.src = f.src AND e.dst = f.dst""",
        "heaviest_edges": edges + "SELECT src, dst, round(w, 6) AS w FROM e ORDER BY e.w DESC, src, dst LIMIT 25",
        "edges_sorted": edges + """SELECT row_number() OVER (ORDER BY e.w, src, dst) - 1 AS pos, src, dst,
          round(w, 6) AS w FROM e""",
        "random_partition": f"""SELECT id, CAST((row_number() OVER (ORDER BY {_u(_lit('3-u'), 'id')}, id) - 1) % 7 AS INTEGER) AS u,
          CAST((row_number() OVER (ORDER BY {_u(_lit('3-v'), 'id')}, id) - 1) % 7 AS INTEGER) AS v FROM ({C2})""",
        "perturb_weights": arcs + f"SELECT src, dst, round({PERTURB.format(u=_u(_lit(42), *PAIR))}, 3) AS w FROM ar",
        "bucket_weights": f"""WITH e AS MATERIALIZED ({EL}), {_bounds('SELECT * FROM e', 0.2, 0.1, 3)}
          SELECT src, dst, CAST((SELECT count(*) FROM bounds WHERE hi <= e.w) + 1 AS DOUBLE) AS w FROM e""",
        "random_weight_gaussian": edges + f"""SELECT src, dst, round(list_extract([5.0, 10.0, 15.0, 20.0, 25.0]::DOUBLE[],
          CAST(floor({gauss_u['mean']} * 5) AS INTEGER) + 1) + sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {gauss_u['radius']}))
          * cos(2.0::DOUBLE * pi() * {gauss_u['angle']}), 6) AS w FROM e""",
        "random_weight_zipf": edges + f", drawn AS MATERIALIZED ({drawn}), cdf AS MATERIALIZED ({CDF}) {ZIPF}",
        "random_weight_uniform": edges + f"SELECT src, dst, round({_u(_lit(5), *PAIR)}, 6) AS w FROM e",
        "size_parameters": edges + """, s AS (SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n,
            count(*) AS m FROM e),
          c AS (SELECT n, m, ln(CAST(m AS DOUBLE) / n) / ln(n) AS c, pow(n, 1.125::DOUBLE) AS budget FROM s)
          SELECT n, m, round(c, 6) AS c, round(budget, 6) AS budget, greatest(1, CAST(ceil(m / budget) AS BIGINT)) AS buckets,
          CASE WHEN c <= 0.125 THEN 1 ELSE CAST(ceil(pow(n, (c - 0.125::DOUBLE) / 2)) AS BIGINT) END AS parts FROM c""",
        "standardize": """SELECT p_partkey AS id,
          round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS x,
          round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS y FROM part""",
        "first_two": f"SELECT id, round(f[1], 6) AS x, round(f[2], 6) AS y FROM ({PE})",
        "mst_1d": f"""SELECT w, count(*) AS n FROM (SELECT round(lead(x) OVER (ORDER BY x, id) - x, 6) AS w FROM ({C1}))
          WHERE w IS NOT NULL GROUP BY w""",
        "mst_cut_1d": f"""WITH g AS (SELECT id, x, x - lag(x) OVER (ORDER BY x, id) AS gap FROM ({P1})),
          cut AS (SELECT id FROM g WHERE gap IS NOT NULL ORDER BY gap DESC LIMIT 2),
          s AS (SELECT id, sum(CASE WHEN id IN (SELECT id FROM cut) THEN 1 ELSE 0 END) OVER (ORDER BY x, id) AS part FROM g)
          SELECT min(id) AS comp, count(*) AS n FROM s GROUP BY part""",
        "mst_2d": rec + _forest(_pairs(P2, D2), 10) + " " + forest_out,
        "mst_planar": rec + _forest(_pairs(C2, D2), 12) + " " + forest_out,
        "mst_manhattan": rec + _forest(_pairs(P2, "abs(a.x - b.x) + abs(a.y - b.y)"), 10) + " " + forest_out,
        "mst_embeddings": rec + _forest(_pairs(PE, DE), 9) + " " + forest_out,
        "mst_vertex_partition": rec + _forest(EL, edge_rounds) + " " + forest_out,
        "connected_components": comp_e + " SELECT id, comp FROM comps",
        "components_customers": comp_c + " SELECT id, comp FROM comps",
        "forest_segments": rec
        + _forest(_pairs(P2, D2), 10)
        + ", rest AS MATERIALIZED (SELECT * FROM forest EXCEPT (SELECT src, dst, w FROM forest ORDER BY w DESC, src, dst LIMIT 2)), "
        + _components(f"SELECT id FROM ({P2})", "SELECT src, dst FROM rest")
        + f""" SELECT r.src, r.dst, round(r.w, 6) AS w, round(a.x, 6) AS src_x, round(a.y, 6) AS src_y, c.comp,
          round(b.x, 6) AS dst_x, round(b.y, 6) AS dst_y FROM rest r JOIN ({P2}) a ON r.src = a.id
          JOIN ({P2}) b ON r.dst = b.id JOIN comps c ON r.src = c.id""",
        "agglomerate_labels": rec + _linkage(full, single, LINKS, 3) + " " + _labels(LINKS),
        "agglomerate_components": rec
        + _group_linkage(_knn(P2, D2, 4), P2, LINKS, 3)
        + " "
        + _labels(LINKS),
        "agglomerate_merges": rec
        + _linkage(embed_arcs, f"SELECT 0 AS run, id FROM ({PE})", LINKS, 3)
        + f" SELECT id, leader, parent, round FROM ({_merges(LINKS)})",
        "agglomerate_graph": rec
        + _linkage(embed_arcs, f"SELECT 0 AS run, id FROM ({PE})", LINKS, 40)
        + f""" SELECT s.label AS src, d.label AS dst, round(min(w), 6) AS w FROM a0
          JOIN l{LINKS} s ON a0.src = s.id JOIN l{LINKS} d ON a0.dst = d.id WHERE s.label <> d.label GROUP BY 1, 2""",
        "cluster_perturbed": rec
        + f"e AS MATERIALIZED ({one_shift}), {_bounds('SELECT * FROM e', 0.2, 0.1, 9)}, "
        + "q AS MATERIALIZED (SELECT src, dst, CAST((SELECT count(*) FROM bounds WHERE hi <= e.w) + 1 AS DOUBLE) AS w FROM e), "
        + "ar AS MATERIALIZED (SELECT * FROM q UNION ALL SELECT dst, src, w FROM q), "
        + _linkage(
            f"""SELECT 0 AS run, src, dst, w FROM ar QUALIFY row_number() OVER
            (PARTITION BY src ORDER BY w, {_u(_lit(9), 'src', 'dst')}, dst) <= 8""",
            single, LINKS, 3,
        )
        + f" SELECT id, label FROM l{LINKS}",
        "stability_study": rec
        + f"sh AS MATERIALIZED ({shifted}), "
        + _linkage("SELECT * FROM sh UNION ALL SELECT run, dst, src, w FROM sh", rounds_run, LINKS, 3)
        + f""", mg AS MATERIALIZED ({_merges(LINKS)})
          SELECT CAST(p.run AS INTEGER) AS run_a, CAST(q.run AS INTEGER) AS run_b,
          CAST(count(*) FILTER (p.parent <> q.parent) AS BIGINT) AS diff
          FROM mg p JOIN mg q ON p.id = q.id GROUP BY 1, 2""",
        "cluster_segments": rec
        + _linkage(full, single, LINKS, 3)
        + f""", mg AS MATERIALIZED ({_merges(LINKS)}), ix AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS i
            FROM (SELECT DISTINCT label FROM l{LINKS}))
          SELECT m.id, round(a.x, 6) AS x, round(a.y, 6) AS y, m.parent, round(b.x, 6) AS parent_x,
          round(b.y, 6) AS parent_y, l.label, CAST(ix.i % 23 AS INTEGER) AS colour FROM mg m
          JOIN ({P2}) a ON m.id = a.id JOIN ({P2}) b ON m.parent = b.id JOIN l{LINKS} l ON m.id = l.id
          JOIN ix ON l.label = ix.label""",
        "noise_uniform": f"""WITH p AS ({C2}), b AS (SELECT count(*) AS n, max(id) AS last, min(x) AS x0, max(x) AS x1,
            min(y) AS y0, max(y) AS y1 FROM p)
          SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM p UNION ALL
          SELECT last + 1 + i, round(x0 + {_u(_lit('4-x'), 'i')} * (x1 - x0), 6),
          round(y0 + {_u(_lit('4-y'), 'i')} * (y1 - y0), 6)
          FROM b, range(0, CAST(ceil(n * 0.1::DOUBLE) AS BIGINT)) t(i)""",
        "noise_circle": _shape("circle"),
        "noise_hline": _shape("hline"),
        "noise_vline": _shape("vline"),
        "delete_vertices": arcs + f""", v AS (SELECT DISTINCT src AS id FROM ar),
          gone AS MATERIALIZED (SELECT id FROM v QUALIFY row_number() OVER (ORDER BY {_u(_lit(6), 'id')}, id)
            <= ceil((SELECT count(*) FROM v) * 0.05::DOUBLE))
          SELECT src, dst, round(w, 6) AS w FROM ar WHERE src NOT IN (SELECT id FROM gone)
          AND dst NOT IN (SELECT id FROM gone)""",
        "delete_edges": edges + f""", kept AS MATERIALIZED (SELECT src, dst, w FROM e QUALIFY row_number() OVER
            (ORDER BY {_u(_lit(6), 'src', 'dst')}, src, dst) > ceil((SELECT count(*) FROM e) * 0.05::DOUBLE))
          SELECT src, dst, round(w, 6) AS w FROM kept UNION ALL SELECT dst, src, round(w, 6) FROM kept""",
        "dbscan": rec + f"""near AS MATERIALIZED ({_pairs(C2, D2, f'abs(a.x - b.x) <= 60 AND {D2} <= 60')}),
          ar AS MATERIALIZED (SELECT src, dst FROM near UNION ALL SELECT dst, src FROM near),
          core AS MATERIALIZED (SELECT src AS id FROM ar GROUP BY src HAVING count(*) + 1 >= 3), """
        + _components(
            "SELECT id FROM core",
            "SELECT src, dst FROM near WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)",
        )
        + f""", border AS (SELECT src AS id, min(comp) AS comp FROM ar JOIN comps c ON ar.dst = c.id
            WHERE src NOT IN (SELECT id FROM core) GROUP BY src)
          SELECT p.id, coalesce(c.comp, b.comp, -1) AS cluster FROM ({C2}) p
          LEFT JOIN comps c ON p.id = c.id LEFT JOIN border b ON p.id = b.id""",
    }
    squares = "((a.x / a.n - b.x / b.n) * (a.x / a.n - b.x / b.n) + (a.y / a.n - b.y / b.n) * (a.y / a.n - b.y / b.n))"
    ward = f"sqrt(CAST(2 AS DOUBLE) * a.n * b.n / (a.n + b.n) * {squares})"
    sql["linkage_ward"] = _connected_linkage(ward, WARD_ROUNDS)
    sql["linkage_average"] = _connected_linkage("l.total / l.links", WARD_ROUNDS)
    sql["minibatch_kmeans"] = _minibatch(C2, 3, 300, 5, 3)
    branches = _density(C2, D2, (60.0, 120.0, 240.0), 3, 5)
    sql["density_levels"] = branches + _density_levels(3)
    sql["density_clusters"] = branches + " SELECT p.id, coalesce(c.comp, -1) AS cluster FROM p LEFT JOIN chosen c ON p.id = c.id"
    sql["eps_join_salted"] = sql["eps_join_2d"]
    sql["knn_pivots"] = sql["knn_join"]
    sql["eps_join_pivots"] = sql["threshold_edges"]
    sql["mst_line"] = sql["mst_1d"]
    for name in ("mst_sparsified", "mst_two_way", "mst_contraction", "mst_shuffled"):
        sql[name] = sql["mst_vertex_partition"]
    sql["components_shuffled"] = sql["components_customers"]
    sql["agglomerate_shuffled"] = sql["agglomerate_labels"]
    return sql
