"""Best-fit packing of token sequences with dominance reduction.

An instance of packing has at most ``capacity`` different lengths, so all that has to be
decided is decided on their histogram: one row per length, whatever the number of
documents. On it

1. the reduction of Martello and Toth fixes, largest length first, every small set that
   provably dominates all other sets with that length (alone, with one or with two
   partners), for all copies at once, and takes them out of the instance;
2. what remains is packed best-fit decreasing, again in runs of equal sequences.

The plan is a list of runs: so many sequences with so many pieces of each length. A piece
then finds its place from its length and its rank among the pieces of that length. Ranks
come from a window over (length, bucket) with enough buckets that a length held by a
third of all pieces is spread over all tasks.

Defined cases: a null text is empty; an empty text is a piece of its end mark alone; only
texts longer than the capacity are cut; repeated rows are packed each; an empty table
packs into nothing; ``pack`` carries every column of its input along.
"""

from __future__ import annotations

import bisect
import functools
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import shaped, small_batches, texts
from .words import boxed, named

# words remembered by a Python worker, twice this at most
CACHE_WORDS = 500_000
CACHE_CHARS = 48
# characters of several texts that are split into words at once
STEP_CHARS = 1 << 20
# pieces of one length that a task ranks at once, as a mean
RANK_ROWS = 200_000
MIN_BUCKETS = 256

Run = tuple[int, list[tuple[int, int]]]  # (sequences, [(length, pieces in each), ...])


# --- the plan on the histogram ------------------------------------------------------


class _Counts:
    """Pieces left by length, with ordered access to the lengths that have any."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length up to ``most``, with the pieces in ``without`` set aside."""
        aside = Counter(without)
        for i in range(bisect.bisect_right(self.sizes, most) - 1, -1, -1):
            if self.left[self.sizes[i]] > aside[self.sizes[i]]:
                return self.sizes[i]
        return None

    def smallest(self, count: int, without: int) -> list[int]:
        """The ``count`` smallest pieces besides one of length ``without``."""
        return self.smallest_above(0, count, without)

    def smallest_above(self, least: int, count: int, without: int) -> list[int]:
        """The ``count`` smallest pieces longer than ``least``, besides one ``without``."""
        out: list[int] = []
        for size in self.sizes[bisect.bisect_right(self.sizes, least) :]:
            free = self.left[size] - (size == without)
            out += [size] * min(free, count - len(out))
            if len(out) == count:
                break
        return out


def _dominating(counts: _Counts, size: int, capacity: int) -> list[int] | None:
    """Partners that make a dominating set with a piece of ``size``; None if none is proven."""
    room = capacity - size
    small = counts.smallest(3, size)
    if not small or small[0] > room:
        return []  # nothing fits beside it
    first = counts.largest(room, (size,))
    if size + first == capacity or len(small) < 2 or small[0] + small[1] > room:
        return [first]  # a full sequence, or one partner at most
    if len(small) == 3 and sum(small) <= room:
        return None  # three partners fit: no proof by small sets
    # two partners at most: the best pair, compared with the best single partner
    pair, best = None, -1
    for a in reversed(counts.sizes[: bisect.bisect_right(counts.sizes, room)]):
        if counts.left[a] <= (a == size):
            continue
        b = counts.largest(min(room - a, a), (size, a))
        if b is not None and a + b > best:
            pair, best = (a, b), a + b
        if 2 * a <= best:
            break
    if first >= best:
        return [first]
    # a pair with the best single partner dominates unless two pieces between its parts fit:
    # any other pair has its larger part under the larger and its smaller under the smaller
    if pair[0] == first:
        between = counts.smallest_above(pair[1], 2, size)
        if len(between) < 2 or sum(between) > room:
            return list(pair)
    return None


def reduce_by_dominance(counts: _Counts, capacity: int) -> list[Run]:
    """Fix all proven sets, for as many copies as their lengths have."""
    runs: list[Run] = []
    for size in sorted(counts.sizes, reverse=True):
        while counts.left.get(size):
            partners = _dominating(counts, size, capacity)
            if partners is None:
                break
            content = Counter([size, *partners])
            copies = min(counts.left[s] // k for s, k in content.items())
            # fewer pieces mean fewer rivals, so the proof holds until a length runs out
            for s, k in content.items():
                counts.take(s, copies * k)
            runs.append((copies, sorted(content.items(), reverse=True)))
    return runs


def best_fit_decreasing(counts: _Counts, capacity: int) -> list[Run]:
    """Best fit on runs of equal sequences: a length goes to the fullest that it fits in."""
    done: list[Run] = []
    open_runs: dict[int, list[Run]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, copies: int, content: list[tuple[int, int]]) -> None:
        if not copies:
            return
        if room == 0:
            done.append((copies, content))
            return
        if room not in open_runs:
            open_runs[room] = []
            bisect.insort(rooms, room)
        open_runs[room].append((copies, content))

    for size in sorted(counts.sizes, reverse=True):
        left = counts.left[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):  # new sequences
                each = capacity // size
                copies, rest = divmod(left, each)
                put(capacity - each * size, copies, [(size, each)])
                put(capacity - rest * size, 1 if rest else 0, [(size, rest)])
                break
            room = rooms[at]
            copies, content = open_runs[room].pop()
            if not open_runs[room]:
                del open_runs[room]
                rooms.pop(at)
            # after one piece the same sequence is still the fullest that fits another
            each = room // size
            full = min(copies, left // each)
            put(room - each * size, full, [*content, (size, each)])
            left -= full * each
            copies -= full
            if copies and left:
                rest = min(left, each)
                put(room - rest * size, 1, [*content, (size, rest)])
                left -= rest
                copies -= 1
            put(room, copies, content)
    return done + [run for runs in open_runs.values() for run in runs]


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs of equal sequences for ``histogram`` (pieces by length, 1 to ``capacity``)."""
    if any(not 1 <= s <= capacity for s in histogram):
        raise ValueError("lengths must be between 1 and the capacity")
    counts = _Counts(histogram)
    return reduce_by_dominance(counts, capacity) + best_fit_decreasing(counts, capacity)


# --- applying it ---------------------------------------------------------------------


def _places(runs: list[Run]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, pieces in each, first offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranked: Counter[int] = Counter()
    sequence = 0
    for copies, content in runs:
        offset = 0
        for size, each in content:
            rows.setdefault(size, []).append((ranked[size], sequence, each, offset))
            ranked[size] += copies * each
            offset += size * each
        sequence += copies
    return {s: np.array(r, dtype=np.int64).T for s, r in rows.items()}


def pack(pieces: DataFrame, length: str, order_by: list[str], capacity: int = 2048) -> DataFrame:
    """Add sequence_id LONG and offset LONG to every row of ``pieces``.

    ``length`` is a column with 1 to ``capacity``; ``order_by`` orders rows of equal length,
    so that a task that runs again ranks them as before: rows that agree in it must be
    interchangeable.
    """
    stored = Scratch(pieces.sparkSession, "packing").store(pieces)
    # one row per length: at most ``capacity`` rows reach the driver
    histogram = {
        r[0]: r[1]
        for r in stored.df.groupBy(named(length).cast("int").alias("s"))
        .agg(F.count(F.lit(1)))
        .collect()
    }
    places = _places(plan_sequences(histogram, capacity))
    buckets = max(MIN_BUCKETS, -(-stored.rows // RANK_ROWS))
    items = stored.df.select(
        boxed(pieces).alias("item"),
        named(length).cast("int").alias("size"),
        F.pmod(F.xxhash64(*[named(c) for c in order_by]), F.lit(buckets)).alias("bucket"),
    )
    sizes = items.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    order = Window.partitionBy("size", "bucket").orderBy(*[F.col("item")[c] for c in order_by])
    ranked = items.withColumn("row", F.row_number().over(order)).join(starts, ["size", "bucket"])
    ranked = ranked.select("item", "size", (F.col("first") + F.col("row") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).to_numpy()
            rank = batch.column(2).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                first, base, each, start = places[int(s)]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                along, within = np.divmod(rank[rows] - first[run], each[run])
                sequence[rows] = base[run] + along
                offset[rows] = start[run] + within * int(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sequence), pa.array(offset)],
                names=["item", "sequence_id", "offset"],
            )

    placed = ranked.mapInArrow(place, shaped(ranked, "item", "sequence_id long, offset long"))
    return placed.select("item.*", "sequence_id", "offset")


# --- texts to pieces -----------------------------------------------------------------


# between words that are encoded in one call; a word that holds it is encoded alone
_MARK = b"\x01"


class _Words:
    """Ids of words by the tokenizers library, remembered by word.

    The vocabulary ignores case and drops white space, so words between white space are
    encoded independently, and lower-casing A-Z first makes fewer of them. Only a text
    with the start of a special string, which is told by its case, goes in whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.mark = self._ids(_MARK.decode())
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_new(self, new: list[bytes]) -> None:
        plain = [w for w in new if _MARK not in w]
        if len(self.mark) != 4:
            plain = []
        joined = [
            (b" " + _MARK + b" ").join(plain[i : i + 256]).decode()
            for i in range(0, len(plain), 256)
        ]
        mark = int.from_bytes(self.mark, "little") if joined else 0
        for n, e in enumerate(self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == mark).tolist(), len(ids)]
            coded = ids.tobytes()
            words = plain[256 * n : 256 * n + 256]
            for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
                self.known[w] = coded[4 * a + 4 : 4 * b]
        for w in set(new).difference(plain):
            self.known[w] = self._ids(w.decode())

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        split = [() if i in whole else t.encode().lower().split() for i, t in enumerate(texts)]
        known, old = self.known, self.old
        new = []
        for w in set().union(*split):
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    new.append(w)
        self._encode_new(new)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for i in whole:
            out[i] = self._ids(texts[i])
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        if len(known) > self.cache_words:
            self.known, self.old = {}, known
        return out

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The same for any number of texts: only some are split into words at a time."""
        some, chars = [], 0
        for text in texts:
            if some and chars + len(text) > STEP_CHARS:
                yield from self.encode(some)
                some, chars = [], 0
            some.append(text)
            chars += len(text)
        yield from self.encode(some)


@functools.lru_cache(maxsize=2)
def _words(path: str, cache_words: int) -> _Words:
    return _Words(path, cache_words)


def cut_pieces(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, cache_words: int = CACHE_WORDS
) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece INT, start LONG, length LONG, ids BINARY.

    A worker remembers the ids of up to twice ``cache_words`` words, some 250 bytes each.

    A document is its ids and then ``end_id``; longer than ``capacity`` it is cut into
    pieces of that length and a last one. ids are little-endian unsigned 32-bit integers.
    """
    small_batches(docs.sparkSession)
    step, end = 4 * capacity, end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path, cache_words)
        # what an earlier task's batches took goes back before this one's are read
        pa.default_memory_pool().release_unused()
        for batch in batches:
            rows, piece, start, ids = [], [], [], []
            for row, coded in enumerate(words.encode_all(batch.column(1).to_pylist())):
                coded += end
                for n, at in enumerate(range(0, len(coded), step)):
                    rows.append(row)
                    piece.append(n)
                    start.append(at // 4)
                    ids.append(coded[at : at + step])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return texts(docs).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary"
    )
