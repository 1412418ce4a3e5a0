"""Vector codes by product quantisation, with memoised grid cells.

Components become integers, vectors are cut into equal parts, and each part position has its
own codebook, refined by rounds of Lloyd's algorithm in whole numbers. A round is one
pass over the stored integers: every task adds up its parts by nearest entry, Spark adds up
the tasks, and the driver holds the codebooks alone.

To find the nearest entry, a part is hashed by its cell in a coarse grid. For a cell that
a task hasn't met, the smallest and the largest distance of every entry to the cell's box are
taken: an entry whose smallest distance exceeds some other entry's largest is dominated for
all points of the box. The others are remembered with the cell, and each part is compared
exactly with those of its cell only. A cell is known by a hash, and its coordinates are
compared, so two cells with one hash can't be mixed up. The memo has a bound and starts afresh beyond.

Defined cases: vectors that are null, empty or hold null or non-finite components go, and so
do those of another length than the most frequent (the longer one, if several are); a length that the
parts don't divide is filled up with zeros; fewer vectors than entries give fewer
entries; a null vec_id comes last; vectors that share a vec_id start a codebook in their own
order; components are cut to +-2**27 (+-32768 before scaling), so that squared distances stay
exact; repeated rows count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lookup import lookup
from ..scratch import Scratch, Stored
from .common import small_batches

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CELL_BITS = 8  # a cell is 2 ** CELL_BITS wide in every component
CELLS = 1 << 16  # cells that a task remembers for one part position
BOUND = 1 << 27

_TURN = np.random.default_rng(13).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class CellMemo:
    """The entries of one codebook that can be nearest, by cell."""

    def __init__(self, book: np.ndarray, bits: int = CELL_BITS, size: int = CELLS):
        self.book, self.bits, self.size = book, bits, size
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.cells = np.zeros((0, self.book.shape[1]), dtype=np.int64)
        self.open = np.zeros((0, len(self.book)), dtype=bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """(cell, entry): no other entry is nearer at every point of the cell."""
        low = (cells << self.bits)[:, None, :]
        high = low + ((1 << self.bits) - 1)
        gap = np.maximum(np.maximum(low - self.book, self.book - high), 0)
        far = np.maximum(np.abs(self.book - low), np.abs(self.book - high))
        nearest, farthest = (gap * gap).sum(axis=2), (far * far).sum(axis=2)
        return nearest <= farthest.min(axis=1)[:, None]

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """(point, entry): the entry isn't dominated in the point's cell."""
        cells = points >> self.bits
        keys = np.zeros(len(points), dtype=np.uint64)
        for d in range(points.shape[1]):
            keys = (keys ^ cells[:, d].view(np.uint64)) * _TURN[d % len(_TURN)]
            keys ^= keys >> np.uint64(29)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        known = [self.slots.get(k, -1) for k in distinct.tolist()]
        new = np.flatnonzero(np.array(known) < 0)
        if len(self.slots) + len(new) > self.size:
            self._clear()
            new = np.arange(len(distinct))
        if len(new):
            fresh = cells[first[new]]
            at = len(self.cells)
            self.slots.update(zip(distinct[new].tolist(), range(at, at + len(new))))
            self.cells = np.concatenate([self.cells, fresh])
            self.open = np.concatenate([self.open, self.undominated(fresh)])
        slot = np.array([self.slots[k] for k in distinct.tolist()])[inverse]
        out = self.open[slot]
        out[(self.cells[slot] != cells).any(axis=1)] = True
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point, ties to the lower entry."""
        row, entry = np.nonzero(self.candidates(points))
        away = points[row] - self.book[entry]
        distance = np.full((len(points), len(self.book)), np.iinfo(np.int64).max)
        distance[row, entry] = (away * away).sum(axis=1)
        best = distance.argmin(axis=1)
        return best, distance[np.arange(len(points)), best]


@dataclass(frozen=True)
class Codebooks:
    """``books[p]`` holds the entries of part position p as rows."""

    books: list[np.ndarray]

    def digest(self) -> str:
        """Lowercase sha256 of all components by part, entry and position, joined by commas."""
        numbers = ",".join(str(int(v)) for book in self.books for v in book.ravel())
        return hashlib.sha256(numbers.encode()).hexdigest()


def _integers(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, x ARRAY<LONG>) of the vectors that take part, and the length of x."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("v")
    ).where((F.size("v") > 0) & finite)
    lengths = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    first = lengths.first()
    if first is None:
        return rows.select("vec_id", "label", F.col("v").cast("array<long>").alias("x")), 0
    size = first["size"]
    width = -(-size // parts) * parts
    bound = F.lit(float(BOUND))

    def whole(x):
        # floor of a DOUBLE beyond LONG would fail, so the cut comes first
        return F.floor(F.least(F.greatest(x * float(scale), -bound), bound))

    filled = F.concat(F.transform("v", whole), F.array_repeat(F.lit(0).cast("long"), width - size))
    return rows.where(F.size("v") == size).select("vec_id", "label", filled.alias("x")), width


def _parts(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """(row, part, position) of a column of integer vectors."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, width // parts)


def _refined(table: DataFrame, books: list[np.ndarray], width: int, bits: int) -> list[np.ndarray]:
    """One round: parts to their nearest entry, entries to the floored mean of their parts."""
    parts, entries, wide = len(books), len(books[0]), width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [CellMemo(book, bits) for book in books]
        total = np.zeros((parts, entries, wide), dtype=np.int64)
        count = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            x = _parts(batch.column(0), width, parts)
            for p, memo in enumerate(memos):
                best, _ = memo.nearest(x[:, p])
                np.add.at(total[p], best, x[:, p])
                count[p] += np.bincount(best, minlength=entries)
        slots = np.repeat(np.arange(parts * entries), wide)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slots),
                pa.array(np.tile(np.arange(wide), parts * entries)),
                pa.array(np.repeat(count.ravel(), wide)),
                pa.array(total.ravel()),
            ],
            names=["slot", "position", "n", "total"],
        )

    sums = (
        table.select("x")
        .mapInArrow(run, "slot long, position long, n long, total long")
        .groupBy("slot", "position")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .where("n > 0")
        .collect()  # as many rows as the codebooks have components
    )
    out = [book.copy() for book in books]
    for r in sums:
        out[r["slot"] // entries][r["slot"] % entries, r["position"]] = r["total"] // r["n"]
    return out


def train(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    bits: int = CELL_BITS,
) -> tuple[Codebooks, Stored | None]:
    """Codebooks over all of vectors(vec_id, embedding, label), and the stored integers."""
    spark = vectors.sparkSession
    small_batches(spark)
    table, width = _integers(vectors, parts, scale)
    if not width:
        return Codebooks([]), None
    stored = Scratch(spark, "codes").store(table)
    first = stored.df.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, -1)
    books = [start[:, p] for p in range(parts)]
    for _ in range(rounds):
        books = _refined(stored.df, books, width, bits)
    return Codebooks(books), stored


def encode(table: DataFrame, codebooks: Codebooks, bits: int = CELL_BITS) -> DataFrame:
    """table(vec_id, label, x) -> vec_id, label, code ARRAY<INT>, error LONG."""
    books = codebooks.books
    parts = len(books)
    width = parts * books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [CellMemo(book, bits) for book in books]
        for batch in batches:
            x = _parts(batch.column(2), width, parts)
            near = [memo.nearest(x[:, p]) for p, memo in enumerate(memos)]
            codes = np.stack([best for best, _ in near], axis=1).astype(np.int32)
            offsets = np.arange(0, codes.size + 1, parts, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel())),
                    pa.array(sum(distance for _, distance in near)),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return table.mapInArrow(run, "vec_id long, label string, code array<int>, error long")


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    bits: int = CELL_BITS,
) -> tuple[DataFrame, Codebooks]:
    """vectors(vec_id, embedding, label) -> (vec_id, label, code, error) and the codebooks."""
    codebooks, stored = train(vectors, parts, entries, rounds, scale, bits)
    if stored is None:
        kind = "vec_id long, label string, code array<int>, error long"
        return vectors.sparkSession.createDataFrame([], kind), codebooks
    return encode(stored.df, codebooks, bits), codebooks


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Add ``label_error``: the error summed over the rows of an equal label, nulls together."""
    stored = Scratch(codes.sparkSession, "code-errors").store(
        codes.withColumn("_label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    )
    totals = Scratch(codes.sparkSession, "code-errors").store(
        stored.df.groupBy(F.col("_label").alias("id")).agg(F.sum("error").alias("label_error"))
    )
    values = {"label_error": "label_error"}
    return lookup(stored.df, stored.rows, "_label", totals.df, totals.rows, values).drop("_label")
