"""Grid forms of the distance joins for points of up to three dimensions.

Points fall into cells and meet only the points of neighbouring cells. A
crowded cell is split into salted parts: its points are dealt to the parts, and
whoever looks into the cell looks into every part, so no task takes a whole
hot cell.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import flat_distance
from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..scratch import Scratch

GRID_DIMENSIONS = 3
GRID_METRICS = ("euclidean", "manhattan")
HEAVY_CELLS = 4096
CELL_ROWS = 20_000
ROUNDING = 1e-9
MAX_PROBES = 40
FEW_QUERIES = 1000


def _axes(dim: int) -> tuple[list[str], list[str]]:
    return [f"x{i}" for i in range(dim)], [f"c{i}" for i in range(dim)]


def _coordinates(vertices: DataFrame, dim: int) -> DataFrame:
    """(id, x0, x1, ...); a vector of another length is an error."""
    wrong = F.raise_error(F.lit("all feature vectors must have the same length"))
    xs, _ = _axes(dim)
    return vertices.select(
        F.col("id").cast("long").alias("id"),
        *[
            F.when(F.size("features") == dim, F.col("features")[i])
            .otherwise(wrong)
            .cast("double")
            .alias(x)
            for i, x in enumerate(xs)
        ],
    )


def _with_cells(points: DataFrame, dim: int, side: float) -> DataFrame:
    xs, cells = _axes(dim)
    return points.select(
        "*", *[F.floor(F.col(x) / side).cast("long").alias(c) for x, c in zip(xs, cells)]
    )


def _crowded(points: DataFrame, rows: int, cells: list[str], cell_rows: int) -> DataFrame:
    """(cells..., _parts) of crowded cells: at most HEAVY_CELLS can pass the floor."""
    floor = max(cell_rows, rows // HEAVY_CELLS)
    return (
        points.groupBy(*cells)
        .count()
        .where(F.col("count") > floor)
        .select(*cells, F.ceil(F.col("count") / cell_rows).cast("long").alias("_parts"))
    )


def _parts(df: DataFrame, crowded: DataFrame, cells: list[str]) -> DataFrame:
    joined = df.join(F.broadcast(crowded), cells, "left")
    return joined.withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long")))


def _dealt(points: DataFrame, crowded: DataFrame, cells: list[str]) -> DataFrame:
    """Every point in one part of its cell."""
    return _parts(points, crowded, cells).withColumn("_salt", F.expr("pmod(xxhash64(id), _parts)"))


def _looking(points: DataFrame, crowded: DataFrame, cells: list[str], offsets) -> DataFrame:
    """Every point once per part of every cell at the given offsets, and whether it is its own."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(cells, o)]) for o in offsets])
    others = [c for c in points.columns if c not in cells]
    own = F.forall(F.array(*[F.col(f"_step.{c}") for c in cells]), lambda v: v == 0)
    moved = points.withColumn("_step", F.explode(steps)).select(
        *others, *[(F.col(c) + F.col(f"_step.{c}")).alias(c) for c in cells], own.alias("_own")
    )
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    return _parts(moved, crowded, cells).withColumn("_salt", every_part)


def _pair_distance(xs: list[str], metric: str) -> Column:
    return flat_distance([F.col(f"a{x}") for x in xs], [F.col(f"b{x}") for x in xs], metric)


def _renamed(df: DataFrame, keys: list[str], prefix: str, xs: list[str], *more: str) -> DataFrame:
    return df.select(
        *keys, *more, F.col("id").alias(prefix), *[F.col(x).alias(prefix + x) for x in xs]
    )


def eps_join_grid(
    vertices: DataFrame, eps: float, metric: str, dim: int, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """edges: all pairs within ``eps``."""
    xs, cells = _axes(dim)
    stored = Scratch(vertices.sparkSession, "eps").store(
        _with_cells(_coordinates(vertices, dim), dim, eps * (1.0 + ROUNDING))
    )
    points, crowded = stored.df, _crowded(stored.df, stored.rows, cells, cell_rows)
    # the own cell plus one of each two opposite neighbours, so a pair meets once
    half = [o for o in itertools.product((-1, 0, 1), repeat=dim) if o >= (0,) * dim]
    keys = [*cells, "_salt"]
    left = _renamed(_dealt(points, crowded, cells), keys, "a", xs)
    right = _renamed(_looking(points, crowded, cells, half), keys, "b", xs, "_own")
    return (
        left.join(right, keys)
        .where(~F.col("_own") | (F.col("a") < F.col("b")))
        .select(
            F.least("a", "b").alias("src"),
            F.greatest("a", "b").alias("dst"),
            _pair_distance(xs, metric).alias("w"),
        )
        .where(F.col("w") <= eps)
    )


def knn_grid(
    vertices: DataFrame,
    k: int,
    metric: str,
    dim: int,
    cell_rows: int = CELL_ROWS,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """arcs: exact k nearest other vertices, ties by id, by search in growing cells.

    Places are searched instead of points: of equal points only the k+1
    smallest ids can be an answer, and all of them share one. A place is done
    once its (k+1)-th candidate is no farther than a cell side, because
    everything outside the neighbouring cells is farther; the others go on with
    larger cells. Cells start so small that none holds very many candidates.
    """
    scratch = Scratch(vertices.sparkSession, "knn")
    xs, cells = _axes(dim)
    copy = F.row_number().over(Window.partitionBy(*xs).orderBy("id"))
    kept = scratch.store(
        _coordinates(vertices, dim).withColumn("_copy", copy).where(F.col("_copy") <= k + 1),
        places=F.sum((F.col("_copy") == 1).cast("long")),
        **{f"min_{x}": F.min(x) for x in xs},
        **{f"max_{x}": F.max(x) for x in xs},
    )
    if not kept.rows:
        return kept.df.select(F.col("id").alias("src"), F.col("id").alias("dst"), "x0").toDF(
            "src", "dst", "w"
        )
    points = kept.df.select("id", *xs)
    extent = max(kept.metrics[f"max_{x}"] - kept.metrics[f"min_{x}"] for x in xs) or 1.0
    side = extent * ((k + 1) / kept.metrics["places"]) ** (1.0 / dim)
    for _ in range(MAX_PROBES):
        counts = _with_cells(points, dim, side).groupBy(*cells).count()
        if counts.agg(F.max("count")).first()[0] <= 32 * (k + 1):
            break
        side /= 4.0

    everywhere = list(itertools.product((-1, 0, 1), repeat=dim))
    keys = [*cells, "_salt"]
    waiting, open_rows = kept.df.where(F.col("_copy") == 1).select("id", *xs), kept.metrics["places"]
    answers = None
    while open_rows:
        last = side > extent
        located = _with_cells(points, dim, side)
        crowded = _crowded(located, kept.rows, cells, cell_rows)
        found = _renamed(_dealt(located, crowded, cells), keys, "b", xs)
        asking = _looking(_with_cells(waiting, dim, side), crowded, cells, everywhere)
        order = Window.partitionBy("a").orderBy("w", "b")
        best = (
            _renamed(asking, keys, "a", xs)
            .join(found, keys)
            .select("a", *[f"a{x}" for x in xs], "b", _pair_distance(xs, metric).alias("w"))
            .withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= k + 1)
        )
        near = F.array_sort(F.collect_list(F.struct("w", F.col("b").alias("dst"))))
        proven = (F.count(F.lit(1)) == k + 1) & (F.max("w") <= side * (1.0 - ROUNDING))
        level = scratch.store(
            best.groupBy("a", *[F.col(f"a{x}").alias(x) for x in xs]).agg(
                near.alias("near"), (F.lit(last) | proven).alias("done")
            ),
            still=F.sum((~F.col("done")).cast("long")),
        )
        done = level.df.where("done").select(F.array(*xs).alias("id"), "near")
        answers = done if answers is None else answers.unionByName(done)
        waiting = level.df.where(~F.col("done")).select(F.col("a").alias("id"), *xs)
        open_rows = level.metrics["still"] or 0
        side *= 2.0 if open_rows > FEW_QUERIES else 16.0

    everyone = vertices.select(
        F.col("id").cast("long").alias("src"),
        F.transform("features", lambda x: x.cast("double")).alias("_at"),
    )
    rows, places = vertices.count(), kept.metrics["places"]
    # a list of k+1 neighbours is that many times wider than a two-column row
    narrow = Limits(
        limits.broadcast_rows // (k + 2), limits.pointer_rows, limits.finish_edges, limits.heavy_share
    )
    told = lookup(everyone, rows, "_at", answers, places, {"near": "near"}, narrow)
    others = F.slice(
        F.filter("near", lambda e: e["dst"] != F.col("src")), 1, k
    )
    return told.select("src", F.explode(others).alias("_n")).select(
        "src", F.col("_n.dst").alias("dst"), F.col("_n.w").alias("w")
    )
