"""Hierarchical clustering by rounds of best neighbour -> leader -> contraction.

Several independent graphs ("runs") can be clustered by one call: vertex ids
then carry the run number in their high bits, and all runs share every job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookup import DEFAULT_LIMITS, Limits, lookup
from ..scratch import Scratch, Stored
from .contraction import best_of, follow_pointers, rank_by_weight, relabel_ranked

RUN_BITS = 40


def tag_run(id_col: Column, run: Column) -> Column:
    """Vertex id of one run: run number above RUN_BITS bits of id."""
    return F.shiftleft(run.cast("long"), RUN_BITS) + id_col


def run_of(id_col: Column) -> Column:
    return F.shiftright(id_col, RUN_BITS).cast("int")


def untag(id_col: Column) -> Column:
    return id_col.bitwiseAND((1 << RUN_BITS) - 1)


@dataclass
class Hierarchy:
    """What the rounds produced, one table per question.

    ``rounds``: rounds that ran, per run. ``merges``(id, leader, parent, round):
    the first merge of every vertex; survivors are their own leader and parent,
    with round NULL. ``graph``: arcs between the clusters that remain.
    """

    runs: int
    rounds: list[int]
    vertices: Stored
    leaders: list[Stored]
    merges: DataFrame
    graph: DataFrame
    scratch: Scratch
    limits: Limits

    def _run(self, id_col: Column) -> Column:
        return run_of(id_col) if self.runs > 1 else F.lit(0)

    def labels(self) -> DataFrame:
        """labels(round, id, label) for all rounds that ran.

        One pass over the vertices follows the leaders round by round; the
        leader tables shrink, so all but the first few are broadcast.
        """
        wide, rows = self.vertices.df.select("id", F.col("id").alias("l0")), self.vertices.rows
        for i, table in enumerate(self.leaders, start=1):
            if table.rows > self.limits.broadcast_rows and i > 1:
                wide = self.scratch.store(wide).df
            values = {"leader": f"l{i}"}
            wide = lookup(wide, rows, f"l{i - 1}", table.df, table.rows, values, self.limits)
        per_round = [
            F.struct(F.lit(i).alias("round"), F.col(f"l{i}").alias("label"))
            for i in range(1, len(self.leaders) + 1)
        ]
        if not per_round:
            return wide.select(F.lit(0).alias("round"), "id", "l0").where("false").toDF(
                "round", "id", "label"
            )
        long = wide.select("id", F.explode(F.array(*per_round)).alias("_r")).select(
            F.col("_r.round").alias("round"), "id", F.col("_r.label").alias("label")
        )
        if self.runs == 1:
            return long
        done = F.array(*[F.lit(r) for r in self.rounds])
        return long.where(F.col("round") <= F.get(done, run_of(F.col("id"))))

    def final_labels(self) -> DataFrame:
        """labels(id, label) after the last round; the id itself when none ran."""
        wide, rows = self.vertices.df.select("id", F.col("id").alias("label")), self.vertices.rows
        for i, table in enumerate(self.leaders):
            if table.rows > self.limits.broadcast_rows and i:
                wide = self.scratch.store(wide).df
            wide = lookup(
                wide, rows, "label", table.df, table.rows, {"leader": "_up"}, self.limits
            ).select("id", F.coalesce("_up", "label").alias("label"))
        return wide


def agglomerate(
    arcs: DataFrame,
    vertices: DataFrame,
    num_clusters: int = 3,
    leader: str = "path_min",
    max_rounds: int | None = None,
    runs: int = 1,
    limits: Limits = DEFAULT_LIMITS,
) -> Hierarchy:
    """Merge every vertex with its best neighbour's leader, round by round.

    Before each round a run stops when it has at most ``num_clusters`` vertices
    or no arcs left; it also stops after a round that changed nothing. Ties
    follow the total order (w, smaller id, larger id) of the original arcs.
    ``max_rounds`` cuts all runs off after so many rounds; by default nothing does.
    """
    if leader not in ("path_min", "component_min"):
        raise ValueError(f"unknown leader mode {leader!r}")
    scratch = Scratch(arcs.sparkSession, "agglomerate")
    run = run_of if runs > 1 else (lambda id_col: F.lit(0))

    def live_counts(keep: Column) -> dict[str, Column]:
        return {
            f"live_{i}": F.sum(F.when(keep & (run(F.col("id")) == i), 1).otherwise(0))
            for i in range(runs)
        }

    def counts(stored: Stored) -> list[int]:
        return [stored.metrics.get(f"live_{i}") or 0 for i in range(runs)]

    small_rows = limits.broadcast_rows
    start = scratch.store(vertices.select("id").distinct(), **live_counts(F.lit(True)))
    ranked = rank_by_weight(scratch, arcs.where(F.col("w").isNotNull() & ~F.isnan("w")))
    live_arcs, live_ids, alive = ranked, start.df, counts(start)
    rounds, active = [0] * runs, [n > num_clusters for n in alive]
    leaders, merges, round_no = [], [], 0
    while any(active) and live_arcs.rows and round_no != max_rounds:
        round_no += 1
        if not all(active):
            going = [i for i in range(runs) if active[i]]
            usable = live_arcs.df.where(run(F.col("src")).isin(going))
        else:
            usable = live_arcs.df
        best = best_of(
            usable.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "r")
        )
        links = live_ids.join(best.select("id", "nbr"), "id", "left").select(
            "id", F.coalesce("nbr", "id").alias("ptr")
        )
        if sum(alive) > limits.pointer_rows or leader != "path_min":
            links = scratch.store(links).df
        if leader == "path_min":
            stay = F.col("leader") == F.col("id")
            table = follow_pointers(
                scratch, links, sum(alive), limits, path_min=True, **live_counts(stay)
            )
        else:
            from .components import connected_components

            comps = connected_components(
                links.select(F.col("id").alias("src"), F.col("ptr").alias("dst")),
                links.select("id"),
                limits,
            )
            stay = F.col("leader") == F.col("id")
            table = scratch.store(
                links.withColumnRenamed("ptr", "nbr").join(
                    comps.select("id", F.col("comp").alias("leader")), "id"
                ),
                small=sum(alive) <= small_rows,
                **live_counts(stay),
            )
        now = counts(table)
        changed = [now[i] < alive[i] for i in range(runs)]
        if not any(changed):
            break
        for i in range(runs):
            rounds[i] += changed[i]
        leaders.append(table)
        merges.append(
            table.df.where(F.col("leader") != F.col("id")).select(
                "id", "leader", F.col("nbr").alias("parent"), F.lit(round_no).alias("round")
            )
        )
        merged = relabel_ranked(live_arcs.df, live_arcs.rows, ("src", "dst"), table, "leader", limits)
        done, live_arcs = live_arcs, scratch.store(
            merged.where(F.col("src") != F.col("dst"))
            .groupBy("src", "dst")
            .agg(F.min("r").alias("r"), F.min_by("w", "r").alias("w")),
            small=live_arcs.rows <= small_rows,
        )
        scratch.drop(done)
        live_ids = table.df.where(F.col("leader") == F.col("id")).select("id")
        alive = now
        active = [active[i] and changed[i] and now[i] > num_clusters for i in range(runs)]

    survivors = live_ids.select(
        "id",
        F.col("id").alias("leader"),
        F.col("id").alias("parent"),
        F.lit(None).cast("int").alias("round"),
    )
    for part in merges:
        survivors = survivors.unionByName(part)
    graph = live_arcs.df.select("src", "dst", "w")
    return Hierarchy(runs, rounds, start, leaders, survivors, graph, scratch, limits)
