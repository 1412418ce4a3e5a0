"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..scratch import Scratch, Stored
from . import kernels
from .contraction import follow_pointers, relabel_ranked

CHUNK_PAIRS = 1_000_000  # pairs a task reads before it squeezes them
HELD_LINKS = 2_000_000  # links a task holds


def _end(own: str, other: str) -> Column:
    return F.struct(F.col(own).alias("id"), F.col(other).alias("nbr"))


def _squeezed(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the same components, in each task at most one per vertex, and the loops
    of vertices that have no other pair there.

    Only the links so far and one chunk are held; more than HELD_LINKS are handed on.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.array([], np.int64)
        a, b, waiting, held = none, none, [], 0

        def links():
            u = np.concatenate([a, *(w[0] for w in waiting)])
            v = np.concatenate([b, *(w[1] for w in waiting)])
            ids, leader = kernels.component_labels(u, v)
            alone = np.ones(len(ids), dtype=bool)
            alone[np.searchsorted(ids, leader[leader != ids])] = False
            keep = (leader != ids) | alone
            return leader[keep], ids[keep]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            waiting.append([batch.column(n).to_numpy() for n in ("a", "b")])
            held += batch.num_rows
            if held >= max(CHUNK_PAIRS, len(a)):
                a, b = links()
                waiting, held = [], 0
                if len(a) > HELD_LINKS:
                    yield out()
                    a = b = none
        if waiting:
            a, b = links()
        yield out()

    return pairs.mapInArrow(squeeze, "a long, b long")


def _finish(pairs: DataFrame) -> DataFrame:
    """(id, leader) of a remainder of edges whose count was checked to be small."""

    def label(
        key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, leader = kernels.component_labels(
            table.column("a").to_numpy(), table.column("b").to_numpy()
        )
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(leader)], names=["id", "leader"])

    one = pairs.withColumn("_one", F.lit(0)).groupBy("_one")
    return one.applyInArrow(label, "id long, leader long")


def connected_components(
    edges: DataFrame, vertices: DataFrame | None = None, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """components(id, comp): ``comp`` is the smallest id of the component.

    Every vertex points at its smallest neighbour if that is smaller than
    itself; pointers are followed to a root and the graph is contracted, until
    few enough edges are left for one bounded task. Any two rounds at least
    halve the live vertices. Edges that close a cycle within a task go before the first shuffle. ``vertices`` adds isolated vertices.
    """
    scratch = Scratch(edges.sparkSession, "components")
    # the edges are made once, and each task keeps at most one per vertex before any are shuffled
    pairs = edges.select(
        F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")
    ).where("a is not null")
    kept = scratch.store(_squeezed(pairs).distinct(), links=F.sum((F.col("a") != F.col("b")).cast("long")))
    loops = kept.df.where(F.col("a") == F.col("b")).select(F.col("a").alias("id"))
    # without a path, so it is never dropped: the loops are read from it later
    live = Stored(kept.df.where(F.col("a") != F.col("b")), kept.metrics["links"] or 0, "")
    maps = []
    while live.rows:
        if live.rows <= limits.finish_edges:
            maps.append(scratch.store(_finish(live.df), small=True))
            break
        # every vertex points at its smallest neighbour if that is smaller than itself
        links = (
            live.df.select(F.explode(F.array(_end("a", "b"), _end("b", "a"))).alias("_e"))
            .groupBy(F.col("_e.id").alias("id"))
            .agg(F.min("_e.nbr").alias("_n"))
            .select("id", F.least("id", "_n").alias("ptr"))
        )
        table = scratch.store(links)
        roots = follow_pointers(scratch, table.df, table.rows, limits, path_min=True)
        maps.append(roots)
        merged = relabel_ranked(live.df, live.rows, ("a", "b"), roots, "leader", limits)
        lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        done, live = live, scratch.store(
            merged.where(F.col("a") != F.col("b")).select(lo, hi).distinct()
        )
        scratch.drop(done, table)

    spark = edges.sparkSession
    comps = spark.createDataFrame([], "id long, comp long")
    if maps:
        # the maps shrink from round to round, so they are composed from the last one back
        whole = maps[-1]
        for table in reversed(maps[:-1]):
            base, value = table.df.select("id", "leader"), {"leader": "_up"}
            up = lookup(base, table.rows, "leader", whole.df, whole.rows, value, limits)
            whole = scratch.store(
                up.select("id", F.coalesce("_up", "leader").alias("leader")),
                small=table.rows <= limits.broadcast_rows,
            )
        comps = whole.df.select("id", F.col("leader").alias("comp"))
    alone = loops.distinct() if vertices is None else loops.union(vertices.select("id")).distinct()
    alone = alone.join(comps, "id", "left_anti").select("id", F.col("id").alias("comp"))
    return comps.unionByName(alone)
