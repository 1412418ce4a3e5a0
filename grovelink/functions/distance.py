"""Distances between two feature arrays as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "manhattan", "cosine")


def _fold(x: Column, y: Column, term) -> Column:
    return F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda acc, v: acc + v)


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_fold(x, y, lambda p, q: (p - q) * (p - q)))


def manhattan(x: Column, y: Column) -> Column:
    return _fold(x, y, lambda p, q: F.abs(p - q))


def dot(x: Column, y: Column) -> Column:
    return _fold(x, y, lambda p, q: p * q)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))


def cosine(x: Column, y: Column) -> Column:
    """1 - cosine similarity; NULL when either vector has zero length."""
    return F.lit(1.0) - F.try_divide(dot(x, y), norm(x) * norm(y))


def distance(x: Column, y: Column, metric: str = "euclidean") -> Column:
    check_metric(metric)
    return {"euclidean": euclidean, "manhattan": manhattan, "cosine": cosine}[metric](x, y)


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")


def flat_distance(left: list[Column], right: list[Column], metric: str) -> Column:
    """Euclidean or Manhattan distance over separate coordinate columns.

    Unlike the array form it stays in generated code.
    """
    total = None
    for p, q in zip(left, right):
        term = (p - q) * (p - q) if metric == "euclidean" else F.abs(p - q)
        total = term if total is None else total + term
    return F.sqrt(total) if metric == "euclidean" else total
