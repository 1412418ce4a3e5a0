"""Size parameters of the edge sparsifier."""

from __future__ import annotations

import math


def density_exponent(n: int, m: int) -> float:
    """c with m = n^(1+c)."""
    return math.log(m / n, n) if n > 1 and m > 0 else 0.0


def edge_budget(n: int, epsilon: float) -> float:
    """Number of edges below which no further sparsifying round is needed."""
    return float(n) ** (1.0 + epsilon)


def bucket_count(n: int, m: int, epsilon: float) -> int:
    """Number of hash buckets of about one edge budget each."""
    return max(1, math.ceil(m / edge_budget(n, epsilon)))


def partition_count(n: int, c: float, epsilon: float) -> int:
    """Number of vertex parts for density exponent c; 1 once c has come down to epsilon."""
    return 1 if c <= epsilon else math.ceil(float(n) ** ((c - epsilon) / 2.0))


def next_exponent(c: float, epsilon: float) -> float:
    return (c - epsilon) / 2.0
