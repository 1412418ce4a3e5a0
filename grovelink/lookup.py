"""Equi-join of a large table with a table that is unique on the key.

Relabelling edges and following pointers are look-ups whose left key may be
extremely skewed: in late rounds most rows point at one giant cluster. A table
of few rows (the count is known, never assumed) is broadcast. Otherwise the
heavy keys of the left side are found by a partially aggregated count; at most
``HEAVY_SHARE`` keys can each hold 1/HEAVY_SHARE of the rows, so their part of
the table is small by construction and is broadcast, while all other keys take
a plain shuffle join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

HEAVY_SHARE = 256


@dataclass(frozen=True)
class Limits:
    """Row bounds, always compared with exact counts.

    ``broadcast_rows``: largest two-column LONG table that may be broadcast.
    ``pointer_rows``: largest pointer table that one task may follow.
    ``finish_edges``: largest remainder of edges that one task may finish.
    Beyond them everything is a shuffle of all tasks.
    """

    broadcast_rows: int = 500_000
    pointer_rows: int = 100_000
    finish_edges: int = 100_000
    heavy_share: int = HEAVY_SHARE


DEFAULT_LIMITS = Limits()
# the path that tables of any size take
SHUFFLE_ONLY = Limits(broadcast_rows=0, pointer_rows=0, finish_edges=0)


def lookup(
    left: DataFrame,
    left_rows: int,
    key: str,
    table: DataFrame,
    table_rows: int,
    values: dict[str, str],
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Left-join ``table`` (unique on ``id``) to ``left`` on ``left[key] = table.id``.

    ``values`` maps a column of ``table`` to the name it gets in the result.
    """
    pick = [F.col(src).alias(dst) for src, dst in values.items()]
    right = table.select(F.col("id").alias("_id"), *pick)
    if table_rows <= limits.broadcast_rows:
        joined = left.join(F.broadcast(right), F.col(key) == F.col("_id"), "left")
        return joined.drop("_id")

    floor = max(1, left_rows // limits.heavy_share)
    heavy = left.groupBy(F.col(key).alias("_id")).count().where(F.col("count") > floor)
    heavy_rows = right.join(F.broadcast(heavy.select("_id")), "_id", "left_semi")
    hot = heavy_rows.select(
        F.col("_id").alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values.values()]
    )
    tagged = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # rows already answered get no key and a spread-out salt that the table never has
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(1 << 30)) + 1
    tagged = tagged.withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(spread)
    ).withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)))
    cold = right.withColumn("_zero", F.lit(0).cast("long"))
    joined = tagged.join(
        cold, (F.col("_key") == F.col("_id")) & (F.col("_salt") == F.col("_zero")), "left"
    )
    return joined.select(
        *left.columns,
        *[F.coalesce(F.col(f"_hot_{v}"), F.col(v)).alias(v) for v in values.values()],
    )


def flags(
    left: DataFrame,
    left_rows: int,
    keys: list[str],
    sets: dict[str, DataFrame],
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add a boolean ``<key>_<name>`` per key and named set(id): is the key in the set?"""
    marks = [
        ids.select("id", *[F.lit(n == name).alias(n) for n in sets]) for name, ids in sets.items()
    ]
    table = marks[0]
    for more in marks[1:]:
        table = table.union(more)
    table = table.groupBy("id").agg(*[F.max(n).alias(n) for n in sets])
    marked = Scratch(left.sparkSession, "flags").store(table)
    for key in keys:
        values = {n: f"{key}_{n}" for n in sets}
        left = lookup(left, left_rows, key, marked.df, marked.rows, values, limits)
        for name in values.values():
            left = left.withColumn(name, F.coalesce(name, F.lit(False)))
    return left
