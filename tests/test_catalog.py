"""Catalog queries against their SQL counterparts on the smallest shared tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["nation", "customer", "supplier", "part", "lineitem", "embeddings"]
# one of each kind; tools/check.py runs all of them
NAMES = [
    "read_polygon_json", "read_edge_csv", "build_graph", "export_edge_map", "all_pairs_manhattan",
    "max_edges", "eps_join_salted", "knn_symmetric", "k_nearest_shuffled", "contract_once",
    "graph_summary", "bucket_histogram", "run_differences", "bucket_msf", "edges_sorted",
    "random_weight_gaussian", "random_weight_zipf", "standardize", "mst_1d", "mst_embeddings",
    "mst_sparsified", "components_customers", "agglomerate_labels", "cluster_segments",
    "noise_circle", "delete_edges", "dbscan",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")


def test_every_sql_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted(tuple(repr(r[i]) for i in order) for r in rel.fetchall())
    assert sorted(names) == cols and got == want
