"""Writers and export shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lookup import DEFAULT_LIMITS, Limits
from ..schema import canonical_edges, nested_adjacency


def write_points_csv(vertices: DataFrame, path: str, dim: int = 2) -> None:
    """Coordinates as CSV columns without header."""
    vertices.select(*[F.col("features")[i].alias(f"x{i}") for i in range(dim)]).write.csv(path)


def export_edge_map(
    edges: DataFrame, max_entries: int = 100_000, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """(src, part, nbrs MAP<dst,w>) over canonical edges; big vertices span several parts."""
    nested = nested_adjacency(canonical_edges(edges), max_entries, limits)
    return nested.select(
        F.col("id").alias("src"), "part", F.map_from_entries("nbrs").alias("nbrs")
    )


def explode_edge_map(edge_map: DataFrame) -> DataFrame:
    """Back from the map form to edges(src, dst, w)."""
    return edge_map.select("src", F.explode("nbrs").alias("dst", "w"))
