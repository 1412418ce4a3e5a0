"""Seeded pseudo-random numbers that do not depend on partitioning.

Every random operator draws ``u = md5(seed|key...)[first 32 bits] / 2^32`` so a
lost partition is recomputed to the same values and any SQL engine with md5 can
check the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(1 << 32)


def hashed_uniform(seed, *keys) -> Column:
    """Uniform double in [0, 1) from ``seed`` and the given columns or names."""
    parts = [F.lit(seed).cast("string") if not isinstance(seed, Column) else seed.cast("string")]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def pair_uniform(seed) -> Column:
    """The same draw for both directions of a pair (src, dst)."""
    return hashed_uniform(seed, F.least("src", "dst"), F.greatest("src", "dst"))
