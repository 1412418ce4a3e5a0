"""Decontamination: benchmark windows inside documents, found by winnowing.

A window is ``span`` consecutive words of a benchmark item, or a whole shorter item. Every
run of as many words has one fingerprint: the smallest hash of its word k-grams. The
choice depends on the words of the run alone, so equal runs have equal fingerprints and
no shared run of ``span`` words can be missed, while neighbouring runs mostly
share theirs.

1. Items give (fingerprint, digest of the window, item) rows. Their fingerprints are also put
   into a bitmap whose size follows their counted number and has an upper bound.
2. One pass over the documents hashes each distinct word of a batch once, slides over the
   word hashes and keeps the windows whose fingerprint is in the bitmap.
3. Fingerprints of both sides are joined. A hit is extended to its whole window in the join's
   key, as a digest of 128 bits over all its words, so a frequent fingerprint that few whole
   windows share meets nothing. Windows that touch become spans of the document.
4. Windows with the same items form a class, and documents with the same classes a profile:
   the item list of a profile is made once, however many documents have it.

Joins with hot keys (a passage that a third of all documents holds) go through ``lookup``:
heavy keys are answered by a broadcast of their few rows. Nothing that grows with the
documents is broadcast or gathered.

Defined cases: a null or empty text, or one without words, has no windows; an item without
words matches nothing; rows that share an item_id are one item; a null item_id marks words
but is listed nowhere; rows that share a doc_id, or have none, are separate documents; empty
tables give no hits or an empty table; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lookup import Limits, lookup
from ..scratch import Scratch
from .common import small_batches
from .words import Words, located, split_words, texts_of

SPAN, GRAM = 10, 6
# the bitmap has so many bits a fingerprint, within these powers of two
BITS_EACH, FEWEST_BITS, MOST_BITS = 32, 16, 27

_LIMITS = Limits(broadcast_rows=20_000, pointer_rows=20_000, finish_edges=20_000)
_rng = np.random.default_rng(12)
_PLACES = _rng.integers(1, 1 << 63, (3, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word, each distinct word hashed once."""
    raw = b"".join(xxhash.xxh3_128_digest(w) for w in words.dictionary.cast(pa.binary()).to_pylist())
    both = np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[words.codes, 0], both[words.codes, 1]


def _runs(h: np.ndarray, length: int, place: int, count: int) -> np.ndarray:
    """A hash of each of the first ``count`` runs of ``length`` values."""
    total = np.full(count, length, dtype=np.uint64)
    for i in range(length):
        total += h[i : i + count] * _PLACES[place, i % 256]
    return _mixed(total, length * 3 + place)


def fingerprints(h: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The fingerprint of every run of ``length`` words: its smallest k-gram hash."""
    k = min(gram, length)
    grams = _runs(h, k, 0, max(0, len(h) - k + 1))
    count = max(0, len(h) - length + 1)
    low = grams[:count].copy()
    for i in range(1, length - k + 1):
        np.minimum(low, grams[i : i + count], out=low)
    # runs of different lengths don't share fingerprints
    return _mixed(low, length)


def windows(words: Words, length: int, gram: int, bitmap: np.ndarray | None, bits: int):
    """(first word, fingerprint, digest, digest) of the windows of ``length`` words whose
    fingerprint is in ``bitmap`` (all without one)."""
    one, two = word_hashes(words)
    prints = fingerprints(one, length, gram)
    inside = np.arange(len(prints)) + length <= words.ends[: len(prints)]
    if bitmap is not None:
        at = prints >> np.uint64(64 - bits)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        inside &= (bitmap[word] >> bit) & np.uint64(1) == 1
    first = np.flatnonzero(inside)
    digests = []
    for place, h in ((1, one), (2, two)):
        total = np.full(len(first), length, dtype=np.uint64)
        for i in range(length):
            total += h[first + i] * _PLACES[place, i % 256]
        digests.append(_mixed(total, length * 3 + place))
    return first, prints[first], *digests


_WINDOW = "length int, print long, high long, low long"


def _item_windows(items: DataFrame, span: int, gram: int) -> DataFrame:
    """(item_id, length, print, high, low): the windows of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column(1))
            rows, lengths = words.rows, np.minimum(words.counts, span)
            for length in np.unique(lengths[lengths > 0]):
                first, *found = windows(words, int(length), gram, None, 0)
                own = lengths[rows[first]] == length
                first, found = first[own], [f[own] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows[first])),
                        pa.array(np.full(len(first), length, dtype=np.int32)),
                        *(pa.array(f.view(np.int64)) for f in found),
                    ],
                    names=["item_id", "length", "print", "high", "low"],
                )

    texts = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = items.select("item_id").schema["item_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"item_id {kind}, {_WINDOW}")


def _bitmap(prints: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bitmap of the first bits of all fingerprints; at most 2 ** MOST_BITS bits."""
    bits = min(MOST_BITS, max(FEWEST_BITS, int(BITS_EACH * max(count, 1) - 1).bit_length()))
    at = F.shiftrightunsigned("print", 64 - bits)
    rows = (
        prints.groupBy(F.shiftright(at, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - bits}) & 63 as int))")).alias("set"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("set").to_numpy().view(np.uint64)
    return out, bits


def _candidates(texts: DataFrame, lengths: list[int], gram: int, bitmap: np.ndarray, bits: int) -> DataFrame:
    """(doc_id, file, row, n_words, hits): every document with its candidate windows."""
    hit = pa.struct(
        [("at", pa.int64()), ("length", pa.int32()), ("print", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column(1))
            rows, parts = words.rows, []
            for length in lengths:
                first, *found = windows(words, length, gram, bitmap, bits)
                parts.append([rows[first], first, np.full(len(first), length), *(f.view(np.int64) for f in found)])
            row, first, length, *found = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 6
            order = np.argsort(row, kind="stable")
            row, first = row[order], first[order]
            values = [first - words.starts[row], length[order].astype(np.int32), *(f[order] for f in found)]
            hits = pa.StructArray.from_arrays(
                [pa.array(v, t.type) for v, t in zip(values, hit)], fields=list(hit)
            )
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in (0, 2, 3)),
                    pa.array(words.counts),
                    pa.ListArray.from_arrays(pa.array(offsets), hits),
                ],
                names=["doc_id", "file", "row", "n_words", "hits"],
            )

    return texts.mapInArrow(
        run,
        "doc_id long, file string, row long, n_words long, "
        "hits array<struct<at: long, length: int, print: long, high: long, low: long>>",
    )


def _by_document(found: DataFrame) -> DataFrame:
    """(number, n_hit, spans, classes) from the matched windows of the documents.

    ``spans`` are the maximal runs of hit words as (start, stop) word positions.
    """
    order = Window.partitionBy("number").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > before, F.lit(True))
    islands = (
        found.withColumn("new", new)
        .withColumn("island", F.sum(F.col("new").cast("long")).over(order))
        .groupBy("number", "island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_set("class").alias("classes"))
    )
    return islands.groupBy("number").agg(
        F.sum(F.col("stop") - F.col("start")).alias("n_hit"),
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"),
    )


def _marked(scratch: Scratch, places: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc_id, file, row, n_words, n_hit, spans, items): one row per document."""
    shape = F.struct("length", "print", "high", "low").alias("window")
    held = scratch.store(_item_windows(items, span, gram).select("item_id", shape).distinct()).df
    # the class of a window: the set of its items, as a digest that needs no list of them
    item = F.col("item_id").cast("string")
    marks = [F.bit_xor(F.xxhash64(item, F.lit(i))).alias(f"x{i}") for i in range(2)]
    kinds = scratch.store(
        held.groupBy("window")
        .agg(F.count("item_id").alias("n"), *marks)
        .select("window", F.struct("n", *[F.coalesce(f"x{i}", F.lit(0)).alias(f"x{i}") for i in range(2)]).alias("class"))
    )
    heads = kinds.df.groupBy("class").agg(F.min("window").alias("window"))
    members = scratch.store(
        held.where("item_id IS NOT NULL").join(heads, "window").select("class", item.alias("item"))
    ).df
    prints = kinds.df.select("window.print").distinct()
    bitmap, bits = _bitmap(prints, prints.count())
    lengths = [r[0] for r in kinds.df.select("window.length").distinct().collect()]  # at most ``span``

    numbered = _candidates(texts_of(places), sorted(lengths), gram, bitmap, bits)
    docs = scratch.store(numbered.withColumn("number", F.monotonically_increasing_id())).df
    hits = docs.where(F.size("hits") > 0).select("number", F.explode("hits").alias("hit"))
    hits = scratch.store(
        hits.select(
            "number",
            F.col("hit.at").alias("start"),
            (F.col("hit.at") + F.col("hit.length")).alias("stop"),
            F.struct("hit.length", "hit.print", "hit.high", "hit.low").alias("window"),
        )
    )
    table = kinds.df.withColumnRenamed("window", "id")
    met = lookup(hits.df, hits.rows, "window", table, kinds.rows, {"class": "class"}, _LIMITS)
    hit_docs = _by_document(met.where("class IS NOT NULL").select("number", "start", "stop", "class"))
    hit_docs = scratch.store(hit_docs.withColumn("profile", F.sha2(F.to_json("classes"), 256)))

    profiles = scratch.store(hit_docs.df.groupBy("profile").agg(F.first("classes").alias("classes")))
    pieces = scratch.store(profiles.df.select("profile", F.explode("classes").alias("class"))).df
    listed = (
        pieces.join(members, "class")
        .select("profile", "item")
        .distinct()
        .groupBy("profile")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    listed = scratch.store(listed.withColumnRenamed("profile", "id"))
    values = {"items": "items"}
    told = lookup(hit_docs.df, hit_docs.rows, "profile", listed.df, listed.rows, values, _LIMITS)
    return docs.drop("hits").join(told.select("number", "n_hit", "spans", "items"), "number", "left").select(
        "doc_id",
        "file",
        "row",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start: long, stop: long>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text, ...), items(item_id, text, ...) -> doc_id, n_words, n_hit, spans, items.

    One row per document; ``spans`` are maximal runs of hit words as (start, stop), ``items``
    the ids of the items with a window in the document, sorted as strings.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    marked = _marked(scratch, located(scratch, docs), items, span, gram)
    return marked.select("doc_id", "n_words", "n_hit", "spans", "items")


def clean_documents(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The documents without a hit, with all their columns."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    places = located(scratch, docs)
    marked = _marked(scratch, places, items, span, gram).where("n_hit > 0")
    return places.join(marked.select("file", "row"), ["file", "row"], "left_anti").select("document.*")
