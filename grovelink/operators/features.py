"""Feature tables to vertices, and feature transforms."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_COLUMN = "signal"
FEATURE_PREFIX = "f"


def select_features(
    columns: list[str],
    feature_columns: list[str] | None = None,
    use_all: bool = True,
    label: str = LABEL_COLUMN,
) -> list[str]:
    """Names of the feature columns.

    All but the label; or the given list (a missing name is an error); or all
    columns that start with ``f``.
    """
    if use_all:
        return [c for c in columns if c != label]
    if feature_columns:
        missing = missing_columns(feature_columns, columns)
        if missing:
            raise ValueError(f"features not in the table: {missing}")
        return list(feature_columns)
    return [c for c in columns if c.startswith(FEATURE_PREFIX)]


def missing_columns(wanted: list[str], present: list[str]) -> list[str]:
    return sorted(set(wanted) - set(present))


def make_vertices(
    table: DataFrame, features: list[str], id_col: str = "id", label: str | None = LABEL_COLUMN
) -> DataFrame:
    """vertices(id, features, label) from columns of a table."""
    tag = F.col(label).cast("double") if label else F.lit(None).cast("double")
    return table.select(
        F.col(id_col).cast("long").alias("id"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("features"),
        tag.alias("label"),
    )


def _moments(vertices: DataFrame) -> tuple[list[float], list[float]]:
    """Per-feature mean and population standard deviation: two numbers per dimension."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(
        array_to_vector(F.col("features"))
    )
    row = vertices.agg(summary.alias("_s")).first()["_s"]
    n = row["count"]
    if not n:
        return [], []
    return list(row["mean"]), [math.sqrt(v * (n - 1) / n) for v in row["variance"]]


def _literals(values: list[float]):
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def standardize(vertices: DataFrame) -> DataFrame:
    """Zero mean and unit population deviation per feature; constant features become 0."""
    mean, sd = _moments(vertices)
    centred = F.zip_with("features", _literals(mean), lambda x, m: x - m)
    scaled = F.zip_with(centred, _literals(sd), lambda x, s: F.when(s == 0.0, 0.0).otherwise(x / s))
    return vertices.withColumn("features", scaled)


def first_two(vertices: DataFrame) -> DataFrame:
    """The first two features of every vertex."""
    return vertices.withColumn("features", F.slice("features", 1, 2))


def pca_project(vertices: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """The top ``k`` principal components of the centred features, and the variance shares."""
    mean = _literals(_moments(vertices)[0])
    centred = vertices.withColumn(
        "_v", array_to_vector(F.zip_with("features", mean, lambda x, m: x - m))
    )
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(centred)
    projected = model.transform(centred).withColumn("features", vector_to_array("_p"))
    return projected.select(*vertices.columns), list(model.explainedVariance.toArray())
