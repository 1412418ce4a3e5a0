"""Removal of repeated byte strings with a bounded interval expansion on a BWT.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too, in
the same or another document.

1. Anchors. Every window of ``length`` bytes has one anchor: the place of its smallest
   hashed ``GRAM``-gram, the leftmost of equal ones. It depends on the window's content
   alone, so equal windows have equal anchors at equal places. Neighbouring windows
   share anchors: a document has about one per 70 bytes, each with the run of windows it
   stands for and a digest of their bytes (the context).
2. Anchors that occur once have no repeated window. Of the others, equal contexts are
   folded to one with its number of occurrences.
3. Contexts that differ under one anchor are dealt to buckets by anchor. A bucket's contexts
   are joined into one text, whose suffix array and Burrows-Wheeler transform are made.
   Breadth first from the empty string, intervals of the transform are extended backwards
   by one byte; an end of an interval that is reached for the first time at depth d has a
   longest common prefix of d - 1 with its successor. So common prefixes become known by
   increasing value, and the expansion stops at ``length``: what is still unknown then
   shares at least ``length`` bytes with its neighbour. These are the repeated windows,
   beside all windows of contexts that occur more than once.
4. An anchor with more than ``group`` different contexts isn't dealt to a bucket. Its
   windows are split in two runs by the side that reaches further from the gram; all
   windows of a run share that side's bytes, which make a longer anchor. Steps 2 and 3 are
   done again for these, and only if one is still too frequent, its windows are counted
   by their digests, each a row of its own. So no group grows with a frequent line.
5. The repeated windows of all occurrences are cut out of the documents.

Defined cases: a null text is empty; a text shorter than ``length`` stays; repeated rows (also
with equal doc_id) repeat each other and go if they are long enough; a doc_id may have
several texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import small_batches, texts

LENGTH, GRAM = 200, 64
GROUP = 8000  # different contexts of an anchor that a bucket takes
BUCKET_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- anchors ------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hashes of all GRAM-grams, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    size, power = 1, _ODD
    while size < GRAM:
        h = h[: len(h) - size] * power + h[size:]
        size, power = 2 * size, np.uint64(int(power) * int(power) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[: len(keys) - size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor's gram, first window, windows) of every anchor of a text."""
    hashes = _gram_hashes(data)
    # hash in front, place behind: the minimum is the leftmost smallest
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    low = _window_minima(keys, length - GRAM + 1)
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    return hashes[at[first]].view(np.int64), first, count


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(uid, anchor, context, start, windows) of every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, contexts = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                coded = text.encode()
                if len(coded) < length:
                    continue
                found = anchors(np.frombuffer(coded, dtype=np.uint8), length)
                rows.append(np.full(len(found[0]), row))
                parts.append(found)
                contexts += [
                    xxhash.xxh3_64_intdigest(coded[s : s + n + length - 1]) - (1 << 63)
                    for s, n in zip(found[1].tolist(), found[2].tolist())
                ]
            if not rows:
                continue
            anchor, start, windows = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.concatenate(rows))),
                    pa.array(anchor),
                    pa.array(contexts, pa.int64()),
                    pa.array(start.astype(np.int32)),
                    pa.array(windows.astype(np.int32)),
                ],
                names=["uid", "anchor", "context", "start", "windows"],
            )

    return docs.mapInArrow(
        run, "uid long, anchor long, context long, start int, windows int"
    )


# --- the transform ------------------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of ``data`` (integers from 0), by doubling the sorted prefix.

    The first order is that of as many symbols as fit one integer. Only suffixes that still tie
    are sorted again. Ties beyond ``depth`` are resolved as well: the doubling goes on until none
    is left.
    """
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64)
    bits = int(data.max() + 1).bit_length()
    # a symbol is one more than its number: behind the end is 0, in front of all
    key, size, most = data + 1, 1, 63 // bits
    while size < most:
        # the symbols of the key, then as many of the key behind them as there is room for
        more = min(size, most - size)
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(n - size, 0)] = key[size:] >> bits * (size - more)
        key = key << bits * more | ahead
        size += more
    order = np.argsort(key)
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        # suffixes whose rank is shared by a neighbour in the order
        where = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if not len(where):
            return order
        own = order[where]
        ahead = own + size
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + follow
        again = np.argsort(key)
        own, key = own[again], key[again]
        order[where] = own
        new_head = np.r_[True, key[1:] != key[:-1]]
        head[where] = new_head
        starts = np.maximum.accumulate(np.where(new_head, np.arange(len(where)), 0))
        rank[own] = where[starts]
        size *= 2


def unknown_prefixes(bwt: np.ndarray, symbols: int, length: int) -> np.ndarray:
    """Breadth-first interval expansion: True where rows r - 1 and r of the sorted suffixes
    share at least ``length`` symbols.

    ``bwt`` holds the symbol in front of each sorted suffix. The intervals of one depth are
    extended together: their rows are mapped backwards, and runs of one symbol in one
    interval are the intervals of the next depth. An interval whose end is known already
    is not extended, so over all depths an end is the cause of one extension. Neighbouring rows
    with one symbol are mapped together, by their first and their last.
    """
    n = len(bwt)
    unknown = np.ones(n + 1, dtype=bool)
    unknown[0] = unknown[n] = False
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, dtype=np.int64)  # row of the suffix that is one symbol longer
    back[by_symbol] = np.arange(n)
    head = np.r_[True, bwt[1:] != bwt[:-1]][:n]
    run = np.cumsum(head) - 1  # the run of equal symbols that a row is in
    starts = np.flatnonzero(head)
    ends = np.r_[starts[1:], n]
    symbol = bwt[starts]
    low, high = np.array([0]), np.array([n])  # intervals [low, high)
    if not n:
        return unknown[:n]
    for _ in range(length):
        # all runs of the intervals, with the interval that they are in
        from_run = run[low]
        size = run[high - 1] - from_run + 1
        ids = np.repeat(np.arange(len(low)), size)
        runs = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - from_run, size)
        key = ids * symbols + symbol[runs]
        if (key[1:] < key[:-1]).any():
            by = np.argsort(key, kind="stable")
            key, runs, ids = key[by], runs[by], ids[by]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.r_[head[1:], len(key)] - 1
        first_row = np.maximum(starts[runs[head]], low[ids[head]])
        last_row = np.minimum(ends[runs[last]], high[ids[last]]) - 1
        low, high = back[first_row], back[last_row] + 1
        fresh = unknown[high]
        low, high = low[fresh], high[fresh]
        # several intervals of a depth never end in one place
        unknown[high] = False
        if not len(low):
            break
    return unknown[:n]


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, the places of windows that occur more than once in all of them."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    # a separator of its own behind each context, smaller than all bytes
    data = np.empty(sizes.sum() + len(contexts), dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    mask = np.ones(len(data), dtype=bool)
    mask[ends] = False
    data[mask] = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.int64) + len(contexts)
    data[ends] = np.arange(len(contexts))
    order = suffix_array(data, length)
    bwt = data[order - 1]
    known = np.unique(bwt)
    shared = unknown_prefixes(np.searchsorted(known, bwt), len(known), length)
    hit = np.zeros(len(data), dtype=bool)
    pairs = np.flatnonzero(shared)
    hit[order[pairs]] = True
    hit[order[pairs - 1]] = True
    starts = ends - sizes
    places = np.flatnonzero(hit)
    owner = np.searchsorted(ends, places)
    return np.split(places - starts[owner], np.searchsorted(owner, np.arange(1, len(contexts))))


# --- on DataFrames --------------------------------------------------------------------------


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of runs of neighbouring places."""
    if not len(places):
        return []
    head = np.flatnonzero(np.r_[True, np.diff(places) > 1])
    count = np.diff(np.r_[head, len(places)])
    return list(zip(places[head].tolist(), count.tolist()))


_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))
RUNS = "array<struct<first:int,count:int>>"


def repeated_runs(docs: DataFrame, scratch: Scratch, length: int, group: int) -> DataFrame:
    """docs(uid, text) -> (uid, runs): runs of repeated windows, in no order."""
    seen = scratch.store(_occurrences(docs, length))
    often = (
        seen.df.groupBy("anchor").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    )
    # a frequent anchor is a skewed key of this sort-merge join, which Spark splits
    shared = scratch.store(seen.df.join(often.select("anchor"), "anchor"))
    scratch.drop(seen)
    folded = scratch.store(
        shared.df.groupBy("anchor", "context", "windows").agg(
            F.count(F.lit(1)).alias("times"), F.min(F.struct("uid", "start")).alias("place")
        )
    )
    kinds = folded.df.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    # one context under an anchor: it occurs several times, and nothing is left to compare
    compared = folded.df.join(kinds.where("kinds > 1"), "anchor")
    wanted = compared.groupBy(F.col("place.uid").alias("uid")).agg(
        F.collect_list(
            F.struct("anchor", "context", F.col("place.start").alias("start"), "windows", "times", "kinds")
        ).alias("contexts")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {k: [] for k in ("anchor", "context", "times", "kinds", "bytes")}
            for text, contexts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = text.encode()
                for c in contexts:
                    own = coded[c["start"] : c["start"] + c["windows"] + length - 1]
                    # a uid may stand for several texts: the context is in one of them
                    if xxhash.xxh3_64_intdigest(own) - (1 << 63) == c["context"]:
                        for k in ("anchor", "context", "times", "kinds"):
                            found[k].append(c[k])
                        found["bytes"].append(own)
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in found.items()}
            )

    cuts = scratch.store(
        docs.join(wanted, "uid")
        .select("text", "contexts")
        .mapInArrow(cut, "anchor long, context long, times long, kinds long, bytes binary")
        .dropDuplicates(["anchor", "context"]),
        size=F.coalesce(F.sum(F.length("bytes")), F.lit(0)),
    )
    few = cuts.df.where(F.col("kinds") <= group)
    in_buckets = _in_buckets(few, int(cuts.metrics["size"] or 0), length)
    alone = folded.df.where("times > 1").select(
        "anchor",
        "context",
        F.array(F.struct(F.lit(0).alias("first"), F.col("windows").cast("int").alias("count"))).alias("runs"),
    )
    single = alone.join(kinds.where("kinds = 1").select("anchor"), "anchor", "left_semi")
    runs = in_buckets.unionByName(single)
    many = scratch.store(cuts.df.where(F.col("kinds") > group))
    if many.rows:
        runs = runs.unionByName(_by_side(scratch, many.df, length, group))
    runs = scratch.store(runs.where(F.size("runs") > 0))
    return shared.df.join(runs.df, ["anchor", "context"]).select(
        "uid", F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), r["count"].alias("count"))).alias("runs")
    )


def _in_buckets(contexts: DataFrame, size: int, length: int) -> DataFrame:
    """(anchor, context, runs) of contexts(anchor, context, times, bytes) of ``size`` bytes."""
    # buckets hold whole anchors, each with a bounded number of contexts
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(max(1, size // BUCKET_BYTES))).alias("bucket")

    def expand(bucket: pa.Table) -> pa.Table:
        own = bucket.column("bytes").to_pylist()
        runs = [
            [(0, len(c) - length + 1)] if t > 1 else _runs(f)
            for c, f, t in zip(
                own, repeated_windows(own, length), bucket.column("times").to_pylist()
            )
        ]
        return pa.table(
            {
                "anchor": bucket.column("anchor"),
                "context": bucket.column("context"),
                "runs": pa.array([[dict(first=a, count=b) for a, b in r] for r in runs], _RUNS),
            }
        )

    dealt = contexts.select(bucket, "anchor", "context", "times", "bytes")
    return dealt.groupBy("bucket").applyInArrow(
        expand, f"anchor long, context long, runs {RUNS}"
    )


def _by_side(scratch: Scratch, many: DataFrame, length: int, group: int) -> DataFrame:
    """The same for frequent anchors, made longer by the side that reaches further."""
    reach = (length - GRAM + 1) // 2

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, longer, part, first, own = [], [], [], [], []
            for row, context in enumerate(batch.column(3).to_pylist()):
                count = len(context) - length + 1
                data = np.frombuffer(context, dtype=np.uint8)
                at = count - 1 + int((_gram_hashes(data)[count - 1 : length - GRAM + 1] >> np.uint64(32)).argmin())
                cut = min(max(at - reach + 1, 0), count)  # windows before it reach left
                for side, (a, b) in enumerate(((0, cut), (cut, count))):
                    if a == b:
                        continue
                    fixed = context[at - reach : at + GRAM] if side == 0 else context[at : at + GRAM + reach]
                    piece = context[a : b - 1 + length]
                    rows.append(row)
                    longer.append(xxhash.xxh3_64_intdigest(fixed, seed=side) - (1 << 63))
                    part.append(xxhash.xxh3_64_intdigest(piece) - (1 << 63))
                    first.append(a)
                    own.append(piece)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(take) for i in range(3)),
                    pa.array(longer, pa.int64()),
                    pa.array(part, pa.int64()),
                    pa.array(first, pa.int32()),
                    pa.array(own, pa.binary()),
                ],
                names=["anchor", "context", "times", "longer", "part", "first", "bytes"],
            )

    sides = scratch.store(
        many.select("anchor", "context", "times", "bytes").mapInArrow(
            split,
            "anchor long, context long, times long, longer long, part long, first int, bytes binary",
        )
    )
    parts = scratch.store(
        sides.df.groupBy("longer", "part").agg(
            F.sum("times").alias("times"), F.first("bytes").alias("bytes")
        )
    )
    kinds = parts.df.groupBy("longer").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("all")
    )
    again = scratch.store(
        parts.df.join(kinds.where("all > 1"), "longer")
        .withColumnRenamed("longer", "anchor")
        .withColumnRenamed("part", "context"),
        size=F.coalesce(F.sum(F.length("bytes")), F.lit(0)),
    )
    runs = _in_buckets(again.df.where(F.col("kinds") <= group), int(again.metrics["size"] or 0), length)
    runs = runs.unionByName(_by_window(again.df.where(F.col("kinds") > group), length)).toDF(
        "longer", "part", "runs"
    )
    back = sides.df.drop("bytes", "times").join(runs.where(F.size("runs") > 0), ["longer", "part"])
    moved = F.transform(
        "runs", lambda r: F.struct((F.col("first") + r["first"]).alias("first"), r["count"].alias("count"))
    )
    return back.groupBy("anchor", "context").agg(F.flatten(F.collect_list(moved)).alias("runs"))


def _by_window(many: DataFrame, length: int) -> DataFrame:
    """The same answer for anchors with many contexts, from counts of window digests."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, context, times = (batch.column(i).to_pylist() for i in range(3))
            rows, at, high, low = [], [], [], []
            for row, own in enumerate(batch.column(3).to_pylist()):
                for i in range(len(own) - length + 1):
                    key = xxhash.xxh3_128_intdigest(own[i : i + length])
                    rows.append(row)
                    at.append(i)
                    high.append((key >> 64) - (1 << 63))
                    low.append((key & ((1 << 64) - 1)) - (1 << 63))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(take) for i in range(3)),
                    pa.array(at, pa.int32()),
                    pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()),
                ],
                names=["anchor", "context", "times", "first", "high", "low"],
            )

    each = many.select("anchor", "context", "times", "bytes").mapInArrow(
        windows, "anchor long, context long, times long, first int, high long, low long"
    )
    twice = each.groupBy("high", "low").agg(F.sum("times").alias("all")).where("all > 1")
    hit = each.join(twice.select("high", "low"), ["high", "low"])
    one = F.struct("first", F.lit(1).alias("count"))
    return hit.groupBy("anchor", "context").agg(F.collect_list(one).alias("runs"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, spans, kept BINARY.

    ``spans`` are the maximal removed runs ARRAY<STRUCT<first, count>> in bytes of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    # a doc_id may have several texts
    own = texts(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    runs = repeated_runs(own.select("uid", "text"), scratch, length, group)
    by_text = scratch.store(
        runs.groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    )
    joined = own.join(by_text.df, "uid", "left").select("doc_id", "text", "runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "spans", "kept")}
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                coded = text.encode()
                gone = np.zeros(len(coded) + 1, dtype=np.int64)
                for r in runs or ():
                    gone[r["first"]] += 1
                    gone[r["first"] + r["count"] + length - 1] -= 1
                mask = np.cumsum(gone)[:-1] > 0
                spans = _runs(np.flatnonzero(mask))
                rows["n_bytes"].append(len(coded))
                rows["n_removed"].append(int(mask.sum()))
                rows["n_spans"].append(len(spans))
                rows["spans"].append([dict(first=a, count=b) for a, b in spans])
                rows["kept"].append(np.frombuffer(coded, dtype=np.uint8)[~mask].tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), _RUNS, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), kinds))],
                names=["doc_id", *rows],
            )

    return joined.mapInArrow(
        remove,
        f"doc_id long, n_bytes long, n_removed long, n_spans long, spans {RUNS}, kept binary",
    )
