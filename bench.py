"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from grovelink.operators.forest import minimum_spanning_forest  # noqa: E402
from grovelink.operators.pairs import all_pairs  # noqa: E402
from grovelink.plans.catalog import QUERIES, embeddings  # noqa: E402

HEADLINE = [
    "all_pairs_euclidean",
    "knn_join",
    "knn_grid",
    "eps_join_2d",
    "edge_dedup",
    "best_neighbour",
    "contract_once",
    "mst_1d",
    "mst_2d",
    "mst_embeddings",
    "mst_vertex_partition",
    "mst_sparsified",
    "mst_contraction",
    "components_customers",
    "agglomerate_labels",
    "agglomerate_merges",
    "stability_study",
    "dbscan",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rounds = {}
    edges = all_pairs(embeddings(spark, folder))
    for name in ("vertex", "two_way", "hash"):
        start = time.perf_counter()
        done = minimum_spanning_forest(edges, sparsifier=name, canonical=True)
        rounds[name] = {
            "vertices": done.vertices,
            "edges_before_after": done.rounds,
            "seconds": round(time.perf_counter() - start, 3),
        }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sparsifier_rounds": rounds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
