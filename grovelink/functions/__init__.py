from .distance import cosine, distance, euclidean, manhattan
from .hashing import hashed_uniform, pair_uniform
from .scalars import bucket_count, density_exponent, edge_budget, partition_count
from .weights import (
    bucket_bounds,
    bucket_histogram,
    bucketize,
    max_weight,
    perturb_weights,
    random_weight,
)

__all__ = [
    "bucket_bounds",
    "bucket_count",
    "bucket_histogram",
    "bucketize",
    "cosine",
    "density_exponent",
    "distance",
    "edge_budget",
    "euclidean",
    "hashed_uniform",
    "manhattan",
    "max_weight",
    "pair_uniform",
    "partition_count",
    "perturb_weights",
    "random_weight",
]
