import json
import math

import brute
import pytest
from pyspark.sql import functions as F

from grovelink import schema, sources
from grovelink import functions as fn
from grovelink.functions import scalars
from grovelink.operators import compare, features, modify, stats
from grovelink.plans import graphs
from grovelink.scratch import Scratch


def triples(df):
    return sorted((r["src"], r["dst"], r["w"]) for r in df.collect())


def write(path, text):
    path.write_text(text)
    return str(path)


def test_polygon_json(spark, tmp_path):
    doc = {
        "n": 3, "m": 4, "x": [0, 3, 0], "y": [0, 4, 1],
        "edge_i": [0, 1, 1, 0], "edge_j": [1, 0, 2, 1],
    }
    v, arcs = sources.read_polygon_json(spark, write(tmp_path / "g.json", json.dumps(doc, indent=1)))
    assert sorted((r["id"], r["features"]) for r in v.collect()) == [
        (0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [0.0, 1.0])
    ]
    assert triples(arcs) == [(0, 1, 5.0), (1, 0, 5.0), (1, 2, math.sqrt(18))]
    other = {**doc, "x": [0, 6, 0], "y": [0, 8, 1]}
    write(tmp_path / "h.json", json.dumps(other))
    v, arcs = sources.read_polygon_json(spark, str(tmp_path))
    assert v.count() == 6 and v.select("graph", "id").distinct().count() == 6
    ends = arcs.where("src = 0").select(F.regexp_extract("graph", "([a-z])\\.json$", 1).alias("g"), "w")
    assert sorted(map(tuple, ends.collect())) == [("g", 5.0), ("h", 10.0)]


def test_edge_tsv(spark, tmp_path):
    path = write(tmp_path / "e.tsv", "# a\tcomment\n5\t2\t3.5\n2\t5\t1.5\n1\t2\t4\n")
    assert triples(sources.read_edge_tsv(spark, path, weighted=True)) == [(1, 2, 4.0), (2, 5, 1.5)]
    bare = write(tmp_path / "b.tsv", "# x\n5\t2\n2\t5\n1\t2\n")
    for name in ("zipf", "gaussian", "uniform"):
        first, again = (triples(sources.read_edge_tsv(spark, bare, False, name, 3)) for _ in "ab")
        assert first == again and [e[:2] for e in first] == [(1, 2), (2, 5)]


def test_edge_csv_orders_texts(spark, tmp_path):
    path = write(tmp_path / "e.csv", "b,a,2.0\n10,9,1.0\na,b,3.0\n")
    edges, names = sources.read_edge_csv(spark, path)
    name = {r["id"]: r["name"] for r in names.collect()}
    assert [name[i] for i in sorted(name)] == ["10", "9", "a", "b"]
    assert sorted((name[s], name[d], w) for s, d, w in triples(edges)) == [
        ("10", "9", 1.0), ("a", "b", 2.0)
    ]


def test_points_and_named_columns(spark, tmp_path):
    v = sources.read_points_csv(spark, write(tmp_path / "p.csv", "1,2\n3,4\n"))
    assert sorted((r["id"], r["features"]) for r in v.collect()) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    out = str(tmp_path / "out")
    sources.write_points_csv(v, out)
    assert sources.read_points_csv(spark, out).count() == 2
    named = write(tmp_path / "n.csv", "a,b,c\n1,2,3\n4,5,6\n")
    got = sources.read_csv_columns(spark, named, ["c", "a"]).orderBy("id").collect()
    assert [r["features"] for r in got] == [[3.0, 1.0], [6.0, 4.0]]


def test_build_graph(spark, tmp_path):
    text = "signal,f1,f2,z\n" + "\n".join(f"{i % 2},{i},0,{i * 9}" for i in range(6)) + "\n"
    path = write(tmp_path / "f.csv", text)
    v, edges, summary = graphs.build_graph(spark, path, use_all=False, max_samples=5)
    row = summary.first()
    assert row["feature_names"] == ["f1", "f2"] and row["num_vertices"] == 5
    assert row["num_edges"] == 10 and row["max_edge_weight"] == 4.0
    assert row["median_edge_weight"] == 2.0 and row["mean_edge_weight"] == 2.0
    assert [r["label"] for r in v.orderBy("id").collect()] == [0.0, 1.0, 0.0, 1.0, 0.0]
    _, few, _ = graphs.build_graph(spark, path, ["f1"], use_all=False, max_edges=3)
    assert triples(few) == [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 3.0)]
    with pytest.raises(ValueError, match="nope"):
        graphs.build_graph(spark, path, ["nope"], use_all=False)
    none = stats.graph_summary(v, edges.where("false"), ["f1"]).first()
    assert none["num_edges"] == 0 and none["median_edge_weight"] is None


def test_edge_map(spark, make):
    edges = make.edges([(1, 0, 2), (0, 1, 1), (0, 2, 3)])
    back = sources.explode_edge_map(sources.export_edge_map(edges, max_entries=1))
    assert triples(back) == [(0, 1, 1.0), (0, 2, 3.0)]


def test_assign_ids_and_median(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"))
    got = schema.assign_ids(df.repartition(7), "v").collect()
    assert all(r["id"] == r["v"] for r in got)
    assert stats.exact_median(df, "v").first()["median"] == 499.5


def test_size_formulas():
    assert math.isclose(scalars.density_exponent(1500, 1124250), 0.905129, abs_tol=1e-6)
    assert scalars.bucket_count(100, 4950, 0.125) == 28
    assert scalars.partition_count(100, 0.1, 0.125) == 1
    assert scalars.partition_count(100, 0.925, 0.125) == 7


def test_bucket_bounds_never_overlap(make):
    for seed in range(50):
        bounds = fn.bucket_bounds(300.0, 0.2, 0.1, seed)
        assert bounds[0][0] == 0.0 and bounds[-1][1] > 300.0
        assert all(lo <= hi for lo, hi in bounds)
        assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    assert len(fn.bucket_bounds(0.5)) == 1
    edges = make.edges([(0, i, i * 1.7) for i in range(1, 150)])
    bounds = fn.bucket_bounds(fn.max_weight(edges), 0.2, 0.1, 1)
    hist = fn.bucket_histogram(edges, bounds).collect()
    assert sum(r["n"] for r in hist) == 149 and len(hist) == len(bounds)
    for s, d, b in triples(fn.bucketize(edges, bounds)):
        lo, hi = bounds[int(b) - 1]
        assert lo <= d * 1.7 < hi


def test_perturbation(make):
    arcs = schema.edges_to_arcs(make.edges(brute.random_edges(20, 60, 1)))
    old = {(s, d): w for s, d, w in triples(arcs)}
    new = {(s, d): w for s, d, w in triples(fn.perturb_weights(arcs, 0.05, 3))}
    assert all(new[s, d] == new[d, s] for s, d in new)
    assert all(abs(new[e] / 100 - old[e]) <= 0.05 * old[e] + 1e-9 for e in new)


def test_random_weights(spark):
    pairs = spark.range(4000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    zipf = [r["w"] for r in pairs.select(fn.random_weight("zipf", 1).alias("w")).collect()]
    assert abs(sum(w == 1.0 for w in zipf) / 4000 - 6 / math.pi**2) < 0.03
    gauss = [r["w"] for r in pairs.select(fn.random_weight("gaussian", 1).alias("w")).collect()]
    assert abs(sum(gauss) / 4000 - 15) < 0.5
    uniform = [r["w"] for r in pairs.select(fn.random_weight("uniform", 1).alias("w")).collect()]
    assert 0 <= min(uniform) and max(uniform) < 1 and abs(sum(uniform) / 4000 - 0.5) < 0.03


def test_noise(make):
    v = make.points([[0.0, 0.0], [10.0, 0.0], [10.0, 20.0], [0.0, 20.0]] * 5)
    noisy = modify.add_uniform_noise(v, 0.3, 1)
    extra = [r["features"] for r in noisy.where(F.col("id") >= 20).collect()]
    assert len(extra) == 6 and all(0 <= x <= 10 and 0 <= y <= 20 for x, y in extra)
    circle = [r["features"] for r in modify.add_shape_noise(v, "circle").where("id >= 20").collect()]
    assert all(math.isclose(math.hypot(x - 5, y - 10), 3.5) for x, y in circle)
    line = modify.add_shape_noise(v, "horizontal_line").where("id >= 20").orderBy("id").collect()
    assert [r["features"] for r in line] == [[0.0, 10.0], [5.0, 10.0]]
    with pytest.raises(ValueError):
        modify.add_shape_noise(v, "square")
    deep = make.points([[0.0, 0.0, 5.0], [1.0, 2.0, 7.0]]).withColumn("label", F.lit(1.0))
    rows = modify.add_uniform_noise(deep, 1.0, 1).orderBy("id").collect()
    assert [r["label"] for r in rows] == [1.0, 1.0, None, None]
    assert all(len(r["features"]) == 3 and 5 <= r["features"][2] <= 7 for r in rows)
    with pytest.raises(ValueError):
        modify.add_shape_noise(deep, "circle")


def test_deletions_and_partition(make):
    edges = make.edges(brute.random_edges(50, 200, 2))
    arcs = schema.edges_to_arcs(edges)
    kept, left = modify.delete_random_vertices(make.ids(range(50)), arcs, 0.1, 1)
    ids = {r["id"] for r in kept.collect()}
    assert len(ids) == 45
    assert triples(left) == sorted(e for e in triples(arcs) if e[0] in ids and e[1] in ids)
    fewer = {e[:2] for e in triples(modify.delete_random_edges(arcs, 0.1, 1))}
    assert len(fewer) == 360 and all((d, s) in fewer for s, d in fewer)
    parts = modify.random_partition(make.ids(range(50)), 4, 1).collect()
    for col in ("u", "v"):
        sizes = [sum(r[col] == p for r in parts) for p in range(4)]
        assert max(sizes) - min(sizes) <= 1
    assert any(r["u"] != r["v"] for r in parts)


def test_features(make):
    rows = brute.random_points(30, 3, 4)
    v = make.points([r + [7.0] for r in rows])
    got = [r["features"] for r in features.standardize(v).orderBy("id").collect()]
    for k in range(3):
        col = [g[k] for g in got]
        assert abs(sum(col)) < 1e-9 and math.isclose(sum(x * x for x in col) / 30, 1.0)
    assert all(g[3] == 0.0 for g in got)
    flat = make.points([[i, 2 * i, 0] for i in range(10)])
    projected, shares = features.pca_project(flat)
    assert math.isclose(shares[0], 1.0, abs_tol=1e-9)
    assert all(abs(r["features"][1]) < 1e-9 for r in projected.collect())
    assert features.select_features(["signal", "f1", "g"], use_all=True) == ["f1", "g"]
    assert features.select_features(["signal", "f1", "g"], use_all=False) == ["f1"]


def dbscan_brute(points, eps, least):
    n = len(points)
    near = [[j for j in range(n) if brute.euclidean(points[i], points[j]) <= eps] for i in range(n)]
    core = {i for i in range(n) if len(near[i]) >= least}
    label = brute.components(core, [(i, j) for i in core for j in near[i] if j in core])
    return {
        i: label[i] if i in core else min([label[j] for j in near[i] if j in core], default=-1)
        for i in range(n)
    }


@pytest.mark.parametrize("copies", [0, 15])
def test_dbscan(make, copies):
    points = brute.random_points(60, 2, 7) + [[3.0, 3.0]] * copies
    got = {r["id"]: r["cluster"] for r in compare.dbscan(make.points(points), 1.0, 4).collect()}
    assert got == dbscan_brute(points, 1.0, 4)


def test_spark_clusterers(make):
    points = brute.random_points(20, 2, 8) + [[x + 50, y] for x, y in brute.random_points(20, 2, 9)]
    v = make.points(points)
    label = {r["id"]: r["cluster"] for r in compare.kmeans(v, 2).collect()}
    assert len({label[i] for i in range(20)}) == 1 and label[0] != label[20]
    mixed = {r["id"]: r["cluster"] for r in compare.gaussian_mixture(v, 2).collect()}
    assert len(mixed) == 40 and set(mixed.values()) <= {0, 1}
    assert compare.spectral(v, 2, 5).count() == 40


def test_run_differences_and_crosstab(spark, make):
    runs = spark.createDataFrame(
        [(0, 1, 1), (0, 2, 1), (1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, None)],
        "run int, id long, val long",
    )
    got = {(r["run_a"], r["run_b"]): r["diff"] for r in stats.run_differences(runs, [0, 1, 2]).collect()}
    assert got == {
        (0, 0): 0, (1, 1): 0, (2, 2): 0, (0, 1): 1, (1, 0): 1, (0, 2): 2, (2, 0): 2, (1, 2): 2, (2, 1): 2
    }
    comps = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "id long, comp long")
    tab = stats.label_crosstab(comps, make.points([[0.0], [1.0], [2.0]], labels=[1, 0, 1]))
    assert sorted(map(tuple, tab.collect())) == [(0, 0.0, 1), (0, 1.0, 1), (2, 1.0, 1)]


def test_scratch_counts_and_empty(spark):
    scratch = Scratch(spark, "test")
    done = scratch.store(spark.range(10), total=F.sum("id"))
    assert done.rows == 10 and done.metrics["total"] == 45
    empty = scratch.store(spark.range(10).where("id < 0").groupBy("id").count())
    assert empty.rows == 0 and empty.df.count() == 0
    scratch.drop(done)


def test_ids_follow_files_and_rows(spark, tmp_path):
    from grovelink.sources.readers import read_feature_table

    n = 0
    for name, rows in (("a", 10), ("b", 5000), ("c", 3)):
        lines = [f"0,{n + i}" for i in range(rows)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["signal,f1", *lines]) + "\n")
        n += rows
    whole = read_feature_table(spark, str(tmp_path)).collect()
    assert len(whole) == n and all(r.id == r.f1 for r in whole)
    few = read_feature_table(spark, str(tmp_path), max_samples=12).collect()
    assert sorted(r.f1 for r in few) == list(range(12))
