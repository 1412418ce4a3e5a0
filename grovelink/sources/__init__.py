from .readers import (
    first_rows,
    read_csv_columns,
    read_edge_csv,
    read_edge_tsv,
    read_feature_table,
    read_points_csv,
    read_polygon_json,
)
from .sinks import explode_edge_map, export_edge_map, write_points_csv

__all__ = [
    "explode_edge_map",
    "export_edge_map",
    "first_rows",
    "read_csv_columns",
    "read_edge_csv",
    "read_edge_tsv",
    "read_feature_table",
    "read_points_csv",
    "read_polygon_json",
    "write_points_csv",
]
