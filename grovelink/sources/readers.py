"""Readers: graphs and points from JSON, TSV and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weights import random_weight
from ..schema import assign_ids, canonical_edges, first_n

POLYGON_SCHEMA = (
    "n long, m long, x array<double>, y array<double>, edge_i array<long>, edge_j array<long>"
)


def read_polygon_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, arcs) of struct-of-arrays JSON files, one graph per file.

    Both have a column ``graph``, the file's path: ids start from 0 in every file.
    The weight is the 2-D distance of the ends, the stored orientation is kept.
    All arrays of a graph sit in one row, so ends are looked up in place; repeated
    pairs are removed by a grouping.
    """
    doc = spark.read.schema(POLYGON_SCHEMA).json(path, multiLine=True)
    doc = doc.withColumn("graph", F.col("_metadata.file_path"))
    upto = F.slice(F.arrays_zip("x", "y"), F.lit(1), F.col("n").cast("int"))
    vertices = doc.select("graph", F.posexplode(upto).alias("id", "_p")).select(
        "graph", F.col("id").cast("long").alias("id"), F.array("_p.x", "_p.y").alias("features")
    )
    pairs = F.slice(F.arrays_zip("edge_i", "edge_j"), F.lit(1), F.col("m").cast("int"))

    def edge(e):
        dx, dy = (
            F.get(F.col(axis), e["edge_i"].cast("int")) - F.get(F.col(axis), e["edge_j"].cast("int"))
            for axis in ("x", "y")
        )
        return F.struct(
            e["edge_i"].alias("src"), e["edge_j"].alias("dst"), F.sqrt(dy * dy + dx * dx).alias("w")
        )

    arcs = doc.select("graph", F.explode(F.transform(pairs, edge)).alias("_e"))
    arcs = arcs.groupBy("graph", "_e.src", "_e.dst").agg(F.min("_e.w").alias("w"))
    return vertices, arcs


def read_edge_tsv(
    spark: SparkSession,
    path: str,
    weighted: bool = False,
    distribution: str = "zipf",
    seed: int | str = 0,
) -> DataFrame:
    """edges of a tab-separated file with ``#`` comments.

    Without weights in the file each pair draws one from ``distribution``.
    Of repeated pairs the lightest stays.
    """
    schema = "src long, dst long" + (", w double" if weighted else "")
    rows = spark.read.csv(
        path, schema=schema, sep="\t", comment="#", enforceSchema=True,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    if weighted:
        return canonical_edges(rows)
    pairs = canonical_edges(rows.withColumn("w", F.lit(0.0)))
    return pairs.withColumn("w", random_weight(distribution, seed))


def read_edge_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, names): comma CSV without header and with text ids.

    ``names(id, name)`` numbers the distinct texts in their own order, so the
    smaller number is the lexically smaller text.
    """
    rows = spark.read.csv(path, schema="a string, b string, w double")
    texts = rows.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    names = assign_ids(texts, "name")
    first = names.select(F.col("name").alias("a"), F.col("id").alias("src"))
    second = names.select(F.col("name").alias("b"), F.col("id").alias("dst"))
    # one row per pair of texts before the joins, so a hot pair costs nothing
    pairs = (
        rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        .groupBy("a", "b")
        .agg(F.min("w").alias("w"))
    )
    edges = pairs.join(first, "a").join(second, "b").select("src", "dst", "w")
    return canonical_edges(edges), names


def _in_file_order(rows: DataFrame) -> DataFrame:
    """Ids 0..n-1 by file name, then by row in the file, however the files are split."""
    placed = rows.select(
        *rows.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return assign_ids(placed, "_file", "_block", "_at").drop("_file", "_block", "_at")


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """vertices of a CSV with two coordinate columns and no header."""
    rows = spark.read.csv(path, schema="x double, y double")
    return _in_file_order(rows).select("id", F.array("x", "y").alias("features"))


def read_csv_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """vertices from two named columns of a CSV with header, in the requested order."""
    rows = _in_file_order(spark.read.csv(path, header=True))
    return rows.select(
        "id", F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("features")
    )


def read_feature_table(
    spark: SparkSession, path: str, max_samples: int | None = None
) -> DataFrame:
    """(id, columns...): CSV with header, all columns numeric; optionally the first rows only."""
    rows = spark.read.csv(path, header=True)
    numbered = _in_file_order(rows).select(
        "id", *[F.col(f"`{c}`").cast("double").alias(c) for c in rows.columns]
    )
    return numbered.where(F.col("id") < max_samples) if max_samples else numbered


def first_rows(df: DataFrame, order_by: list[str], count: int) -> DataFrame:
    """The first ``count`` rows in the given order."""
    return first_n(df, count, *order_by)
