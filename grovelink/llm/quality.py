"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics come from one pass over each whole text, vectorised over the bytes of a batch.
Trees are grown on binned statistics with a second-order logistic objective and kept as
flat arrays (feature, bin, left child, right child, value), so that a batch is scored by
walking all its rows down all trees with array operations.

Trees are fitted on at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of their
doc_id; everything is scored.

Defined cases: a null text is empty, and an empty text has statistics of zero and gets
the score of those; equal texts get equal scores; null labels are left out, and of several
labels for a document the largest counts; without labels of both kinds every score is the
share of label 1 (0.5 if there are none). An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shaped, small_batches
from .words import boxed

# bound of the training sample; the only part of the work that does not grow with the data
TRAIN_ROWS = 20_000
BINS = 64
STATISTICS = (
    "bytes", "words", "lines", "word_length", "line_length", "upper", "lower", "digit", "space",
    "stop", "comma", "exclamation", "pipe", "symbol", "other_punct", "high", "capital_words",
    "unique_words", "unique_lines", "symbol_ended", "longest_word",
)

# --- statistics -------------------------------------------------------------------------


def _byte_classes() -> np.ndarray:
    """One row of 0/1 per class, by byte value."""
    groups = {
        "upper": range(65, 91),
        "lower": range(97, 123),
        "digit": range(48, 58),
        "space": b" \t\n\r\x0b\x0c",
        "stop": b".",
        "comma": b",;:",
        "exclamation": b"!?",
        "pipe": b"|",
        "symbol": b"#$%&*@^~<>=+\\_{}[]",
        "other_punct": b"\"'()-/`",
        "high": range(128, 256),
    }
    out = np.zeros((len(groups), 256), dtype=np.uint8)
    for row, members in zip(out, groups.values()):
        row[list(members)] = 1
    return out


_CLASSES = _byte_classes()
_SPACE, _SYMBOL, _UPPER = 3, 8, 0


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS per text."""
    coded = [t.encode() for t in texts]
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    out = np.zeros((len(texts), len(STATISTICS)), dtype=np.float64)
    if not sizes.sum():
        return out
    data = np.frombuffer(b"".join(coded), dtype=np.uint8)
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[full]

    def per_text(marks: np.ndarray) -> np.ndarray:
        total = np.zeros(len(texts))
        total[full] = np.add.reduceat(marks, starts, dtype=np.int64)
        return total

    shares = np.stack([per_text(c[data]) for c in _CLASSES], axis=1)
    space = _CLASSES[_SPACE][data].astype(bool)
    first = np.zeros(len(data), dtype=bool)
    first[starts] = True
    before = np.r_[True, space[:-1]] | first
    word_start = ~space & before
    last = np.zeros(len(data), dtype=bool)
    last[ends[full] - 1] = True
    word_end = ~space & (np.r_[space[1:], True] | last)
    upper = _CLASSES[_UPPER][data].astype(bool)
    capital = upper & np.r_[upper[1:], False] & word_start  # at least two capitals in front
    words = per_text(word_start)
    lines = np.array([t.count("\n") + 1 for t in texts], dtype=float)
    bare = sizes - shares[:, _SPACE]
    some = np.maximum(words, 1)
    unique_words, unique_lines, longest = (np.zeros(len(texts)) for _ in range(3))
    for i, c in enumerate(coded):
        parts = c.split()
        unique_words[i] = len(set(parts))
        longest[i] = max(map(len, parts), default=0)
        unique_lines[i] = len(set(c.split(b"\n")))
    out[:, 0] = np.log1p(sizes)
    out[:, 1] = np.log1p(words)
    out[:, 2] = np.log1p(lines)
    out[:, 3] = bare / some
    out[:, 4] = np.log1p(sizes / lines)
    out[:, 5:16] = shares / np.maximum(sizes, 1)[:, None]
    out[:, 16] = per_text(capital) / some
    out[:, 17] = unique_words / some
    out[:, 18] = unique_lines / lines
    out[:, 19] = per_text(word_end & _CLASSES[_SYMBOL][data].astype(bool)) / some
    out[:, 20] = np.log1p(longest)
    out[sizes == 0] = 0
    return out


# --- trees ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays; a node with left < 0 is a leaf."""

    edges: np.ndarray  # (statistics, BINS - 1): upper bounds of the bins
    feature: np.ndarray  # (trees, nodes)
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def binned(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(rows.shape, dtype=np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, rows[:, j], side="left")
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        bins = self.binned(rows)
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                left = self.left[t, node]
                below = bins[every, self.feature[t, node]] <= self.cut[t, node]
                node = np.where(left < 0, node, np.where(below, left, self.right[t, node]))
            total += self.value[t, node]
        return 1.0 / (1.0 + np.exp(-total))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    l2: float = 1.0,
    least: int = 10,
) -> Trees:
    """Boosted trees on binned statistics; the split of a node is the best histogram cut."""
    width = rows.shape[1] if rows.size else len(STATISTICS)
    share = float(labels.mean()) if len(labels) else 0.5
    base = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    nodes = 2 ** (depth + 1) - 1
    if not 0 < share < 1 or not len(labels):
        trees = 0
    edges = np.zeros((width, BINS - 1))
    for j in range(width if len(rows) else 0):
        edges[j] = np.quantile(rows[:, j], np.arange(1, BINS) / BINS)
    shape = (trees, nodes)
    model = Trees(
        edges,
        np.zeros(shape, dtype=np.int64),
        np.zeros(shape, dtype=np.int64),
        np.full(shape, -1, dtype=np.int64),
        np.full(shape, -1, dtype=np.int64),
        np.zeros(shape),
        base,
        depth,
    )
    bins = model.binned(rows) if trees else None
    margin = np.full(len(labels), base)
    for t in range(trees):
        chance = 1.0 / (1.0 + np.exp(-margin))
        gradient, hessian = chance - labels, chance * (1 - chance)
        node = np.zeros(len(labels), dtype=np.int64)
        level = [0]
        for d in range(depth + 1):
            grown = []
            for n in level:
                own = np.flatnonzero(node == n)
                g, h = gradient[own].sum(), hessian[own].sum()
                model.value[t, n] = -rate * g / (h + l2)
                split = None
                if d < depth and len(own) >= 2 * least:
                    split = _best_cut(bins[own], gradient[own], hessian[own], l2, least)
                if split is None:
                    continue
                j, cut = split
                model.feature[t, n], model.cut[t, n] = j, cut
                model.left[t, n], model.right[t, n] = 2 * n + 1, 2 * n + 2
                node[own] = np.where(bins[own, j] <= cut, 2 * n + 1, 2 * n + 2)
                grown += [2 * n + 1, 2 * n + 2]
            level = grown
        margin += model.value[t, node]
    return model


def _best_cut(bins, gradient, hessian, l2: float, least: int) -> tuple[int, int] | None:
    width = bins.shape[1]
    place = (bins.astype(np.int64) + np.arange(width) * BINS).ravel()
    size = width * BINS

    def sums(weights: np.ndarray | None) -> np.ndarray:
        spread = None if weights is None else np.repeat(weights, width)
        found = np.bincount(place, weights=spread, minlength=size)
        return found.reshape(width, BINS).cumsum(axis=1)

    g, h, n = sums(gradient), sums(hessian), sums(None)
    g_all, h_all, n_all = g[0, -1], h[0, -1], n[0, -1]
    gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
    gain[(n < least) | (n_all - n < least)] = -1
    best = int(gain.argmax())
    return divmod(best, BINS) if gain.flat[best] > 1e-6 else None


# --- on DataFrames ----------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Documents whose labels no model may see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Fit on a sample of the labelled documents that aren't held out."""
    small_batches(docs.sparkSession)
    order = [F.xxhash64("doc_id"), "doc_id"]
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(*order)
        .limit(train_rows)
    )
    # at most train_rows rows of two numbers
    sample = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(rows), pa.list_(pa.float64()))],
                names=["doc_id", "quality", "row"],
            )

    found = (
        sample.mapInArrow(run, "doc_id long, quality int, row array<double>")
        .orderBy(*order, "row")
        .limit(train_rows)
        .toArrow()
    )
    rows = np.array(found.column("row").to_pylist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    return fit(rows, found.column("quality").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """document STRUCT (a row of ``docs`` as given) and its score DOUBLE."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        boxed(docs),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(statistics(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores)], names=["document", "score"]
            )

    return rows.mapInArrow(run, shaped(rows, "document", "score double"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents with a score of at least ``least``, with all their columns."""
    return score(docs, train(docs, labels)).where(F.col("score") >= least).select("document.*")
