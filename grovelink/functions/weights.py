"""Edge weights: random draws, perturbation and geometric buckets."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import TWO_32, hashed_uniform, pair_uniform

# fixed values: means and number of the Gaussian weight mixture
MIXTURE_MEANS = [5.0, 10.0, 15.0, 20.0, 25.0]
# fixed value: weights are scaled by this factor when perturbed
PERTURB_SCALE = 100.0
# fixed value: how far the last bucket reaches past the largest weight
LAST_BUCKET_MARGIN = 1e-5

ZETA_2 = math.pi * math.pi / 6.0
ZIPF_TABLE = 128


def zipf_cdf(size: int = ZIPF_TABLE) -> list[float]:
    """P(X <= k) for k = 1..size of the Zipf law with exponent 2."""
    total, table = 0.0, []
    for k in range(1, size + 1):
        total += 1.0 / (k * k)
        table.append(total / ZETA_2)
    return table


def _passed(bounds: list[float], value: Column, inclusive: bool) -> Column:
    """How many of the ascending bounds lie below ``value``, evaluating ``value`` once."""
    table = F.array(*[F.lit(b) for b in bounds]).cast("array<double>")
    count = F.transform(
        F.array(value),
        lambda x: F.size(F.filter(table, lambda b: (b <= x) if inclusive else (b < x))),
    )
    return count[0]


def zipf2(u: Column) -> Column:
    """Zipf(2) by inversion: exact table for small values, tail expansion beyond it."""
    below = _passed(zipf_cdf(), u, inclusive=False).cast("double") + 1.0
    # sum over j > k of 1/j^2 is 1/(k + 1/2) up to O(k^-3)
    tail = F.ceil(F.lit(1.0) / (ZETA_2 * (F.lit(1.0) - u)) - 0.5).cast("double")
    return F.when(below <= ZIPF_TABLE, below).otherwise(F.greatest(tail, F.lit(ZIPF_TABLE + 1.0)))


def gaussian_mixture(seed, sigma: float = 1.0) -> Column:
    """A mean drawn from the mixture plus a Box-Muller normal of width ``sigma``."""
    keys = (F.least("src", "dst"), F.greatest("src", "dst"))
    pick = hashed_uniform(f"{seed}-mean", *keys)
    radius = F.sqrt(-2.0 * F.log(1.0 - hashed_uniform(f"{seed}-radius", *keys)))
    angle = 2.0 * math.pi * hashed_uniform(f"{seed}-angle", *keys)
    means = F.array(*[F.lit(m) for m in MIXTURE_MEANS])
    mean = F.get(means, F.floor(pick * len(MIXTURE_MEANS)).cast("int"))
    return mean + sigma * radius * F.cos(angle)


def random_weight(distribution: str = "zipf", seed: int | str = 0) -> Column:
    """Weight of the pair (src, dst): 'gaussian' mixture, 'zipf' or anything else: uniform."""
    name = distribution.lower()
    if name == "gaussian":
        return gaussian_mixture(seed)
    if name == "zipf":
        return zipf2(pair_uniform(seed))
    return pair_uniform(seed)


def perturb_weights(
    arcs: DataFrame, gamma: float = 0.05, seed: int | str = 0, scale: float = PERTURB_SCALE
) -> DataFrame:
    """w becomes scale * max(w + U(-gamma, gamma) * w, 0), equal in both directions."""
    shift = (2.0 * pair_uniform(seed) - 1.0) * gamma * F.col("w")
    return arcs.withColumn("w", scale * F.greatest(F.col("w") + shift, F.lit(0.0)))


def max_weight(edges: DataFrame) -> float:
    value = edges.agg(F.max("w")).first()[0]
    return 0.0 if value is None else float(value)


def _driver_uniform(seed, *keys) -> float:
    text = "|".join(str(k) for k in (seed, *keys))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / TWO_32


def bucket_bounds(
    max_w: float, beta: float = 0.2, alpha: float = 0.1, seed: int | str = 0
) -> list[tuple[float, float]]:
    """Geometric bucket bounds, each jittered by up to ``alpha`` of itself.

    Their number is ceil(log_{1+beta} max_w), at least one; upper bounds are a
    running maximum, so jitter can leave a bucket empty but never overlap two.
    """
    n = 1 if max_w <= 1.0 else max(1, math.ceil(math.log(max_w) / math.log(1.0 + beta)))
    bounds, lo = [], 0.0
    for i in range(n):
        jitter = 1.0 + (2.0 * _driver_uniform(seed, i) - 1.0) * alpha
        hi = math.pow(1.0 + beta, i) * jitter if i < n - 1 else max_w + LAST_BUCKET_MARGIN
        hi = max(hi, lo)
        bounds.append((lo, hi))
        lo = hi
    return bounds


def bucket_number(w: Column, bounds: list[tuple[float, float]]) -> Column:
    """1-based bucket of ``w``; NULL outside all buckets."""
    last = bounds[-1][1]
    # bounds ascend, so the bucket is one more than the count of passed upper bounds
    passed = _passed([hi for _, hi in bounds[:-1]], w, inclusive=True)
    return F.when((w >= 0.0) & (w < last), (passed + 1).cast("int"))


def bucketize(arcs: DataFrame, bounds: list[tuple[float, float]]) -> DataFrame:
    """Replace each weight by its bucket number; weights outside all buckets stay."""
    return arcs.withColumn(
        "w", F.coalesce(bucket_number(F.col("w"), bounds).cast("double"), F.col("w"))
    )


def bucket_histogram(arcs: DataFrame, bounds: list[tuple[float, float]]) -> DataFrame:
    """buckets(bucket, lo, hi, n): weights per bucket, empty buckets included."""
    spark: SparkSession = arcs.sparkSession
    table = spark.createDataFrame(
        [(i + 1, lo, hi) for i, (lo, hi) in enumerate(bounds)], "bucket int, lo double, hi double"
    )
    counts = (
        arcs.groupBy(bucket_number(F.col("w"), bounds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return table.join(counts, "bucket", "left").select(
        "bucket", "lo", "hi", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )
