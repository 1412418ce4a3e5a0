"""Near-duplicates by a join of inverted lists over MinHash signature coordinates.

1. One pass over the texts hashes the distinct word shingles, counts them, digests the set
   and takes a signature of ``coordinates`` minima. Documents with the same set form a
   class; one of them stands for it from here on, so copies cost nothing more.
2. A class is posted under every (coordinate, value). Values that only one class has can't
   collide; classes with fewer than ``matches`` shared ones have no partner and go.
3. Two classes that agree in at least ``matches`` coordinates agree in one of the first
   s - matches + 1 of either's s shared values, rarest first. Only that prefix is
   joined, the frequent rest is skipped. In the join, postings that differ too much in set
   size for the similarity are skipped as well, and so are pairs that collide too rarely: the
   collisions are counted on sketches of 128 minima that the postings carry.
4. Pairs that agree often enough are confirmed on the full shingle sets.

Large groups of near copies would still meet in all pairs, so steps 3 and 4 run in rounds.
In the first two each class meets only the hub of its list (the smallest, then the largest
id), and what that confirms is merged. Lists that still hold several components are then
merged in full, but only across components: a list is cut into blocks of a bounded number of
classes, a task takes two blocks at a time, counts the coordinates in which two
classes agree, and gives a pair of at least ``matches`` agreements under the first
coordinate alone that both are posted under, so a pair is one row however many lists it
shares. Pairs are left out whose parity bitmaps of 1024 bits differ in more places than
the sets of a linked pair can; the bits never differ in more places than the sets, so this
loses nothing. A list of N classes that are not linked costs N * N / 2 comparisons, in
N * N / (2 * BLOCK_CLASSES ** 2) blocks that are spread over tasks, and no rows.

With 48 coordinates and 21 matches, and 70 of 128 matches in the sketch, a pair at the
threshold of 0.75 is missed with a probability of 2e-6, at 0.8 of 1e-8.

Defined cases: a null text is empty; a text without words has no shingles and no links; one
with fewer words than a shingle is one shingle; repeated rows (also with equal doc_id) are
copies; rows that share a doc_id are separate documents, and a null doc_id is one like any
other, larger than all numbers; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lookup import Limits, lookup
from ..operators.components import connected_components
from ..scratch import Scratch
from .common import Recent, attach_groups, small_batches
from .words import located, texts_of

WORDS, COORDINATES, MATCHES, PERCENT = 5, 48, 21, 75
# a sketch has four bits of each of so many minima; similar sets agree in so many of them
SKETCHED, SKETCH_MATCHES = 128, 70
SKETCH = [f"s{i}" for i in range(SKETCHED // 16)]
# a bit of the bitmap says whether the shingles that fall to it are odd in number
BITMAP_BYTES = 128
CACHE_WORDS = 50_000
BLOCK_CLASSES = 4096  # classes of a list that meet those of another block at once
PAIR_ROWS = 1 << 14  # pairs that a task looks at in one step, so their bitmaps take two megabytes
PARTNERS = 64  # pairs that are confirmed against one class in one group
_BLOCK = 1024

_rng = np.random.default_rng(20_11)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct hashed word shingles of a text."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self._hash = Recent(lambda w: xxhash.xxh3_64_digest(w), CACHE_WORDS)

    def __call__(self, text: str) -> np.ndarray:
        # bytes.lower() changes A-Z only, bytes.split() splits at [\x20\x09-\x0D]+
        parts = text.encode().lower().split()
        if not parts:
            return np.empty(0, dtype=np.uint64)
        h = np.frombuffer(b"".join(map(self._hash.__getitem__, parts)), dtype=">u8").astype(np.uint64)
        n = min(self.words, len(h))
        count = len(h) - n + 1
        total = np.full(count, n, dtype=np.uint64)
        for i in range(n):
            total += h[i : i + count] * _PLACE[i]
        return np.unique(_mixed(total))


def signature(shingles: np.ndarray, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima of SKETCHED permutations: the first ``coordinates`` cut to 32 bits, and
    a sketch of four bits of each, sixteen to a LONG."""
    low = np.full(SKETCHED, np.iinfo(np.uint64).max, dtype=np.uint64)
    turn, flip = _TURN[:SKETCHED, None], _FLIP[:SKETCHED, None]
    for at in range(0, len(shingles), _BLOCK):
        block = shingles[None, at : at + _BLOCK] ^ flip
        block *= turn
        np.minimum(low, block.min(axis=1), out=low)
    values = (low[:coordinates] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    four = ((low >> np.uint64(20)) & np.uint64(15)).reshape(-1, 16)
    sketch = (four << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    return values, sketch.view(np.int64)


def bitmap(shingles: np.ndarray) -> bytes:
    """For each of 1024 bits, whether an odd number of shingles falls to it."""
    places = (shingles & np.uint64(8 * BITMAP_BYTES - 1)).astype(np.int64)
    odd = (np.bincount(places, minlength=8 * BITMAP_BYTES) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def _key(shingles: np.ndarray) -> tuple[int, int]:
    """A digest of the set as two LONGs."""
    key = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63)


def _sets(places: DataFrame, words: int, coordinates: int) -> DataFrame:
    """(doc_id, file, row, n_shingles, set_key LONG pair, signature, number) per document.

    ``number`` is unique; the graph's nodes are numbers, as a doc_id may be null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            size, high, low, rows, sketches, maps = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingler(text)
                one, two = _key(shingles)
                size.append(len(shingles))
                high.append(one)
                low.append(two)
                values, sketch = signature(shingles, coordinates)
                rows.append(values)
                sketches.append(sketch)
                maps.append(bitmap(shingles))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    batch.column(3),
                    pa.array(size, pa.int64()),
                    pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.array(rows, pa.list_(pa.int32())),
                    *(pa.array(c) for c in np.array(sketches).reshape(-1, len(SKETCH)).T),
                    pa.array(maps, pa.binary()),
                ],
                names=["doc_id", "file", "row", "n_shingles", "high", "low", "signature", *SKETCH, "bits"],
            )

    found = places.mapInArrow(
        run,
        "doc_id long, file string, row long, n_shingles long, high long, low long, "
        "signature array<int>, " + ", ".join(f"{c} long" for c in SKETCH) + ", bits binary",
    )
    return found.withColumn("number", F.monotonically_increasing_id())


def _postings(scratch: Scratch, classes: DataFrame, matches: int) -> DataFrame:
    """(key LONG, at, id, n, SKETCH): the prefix of every class that can have a partner."""
    each = scratch.store(
        classes.select("id", "n", F.posexplode("signature").alias("at", "value")).select(
            "id", "n", "at", F.xxhash64("at", "value").alias("key")
        )
    )
    often = scratch.store(
        each.df.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    )
    shared = (
        attach_groups(each.df, often.df, "key", "often", each.rows)
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("often", "key", "at"))).alias("values"))
        .where(F.size("values") >= matches)
    )
    prefix = F.slice("values", F.lit(1), F.size("values") - (matches - 1))
    posted = shared.select("id", "n", F.explode(prefix).alias("_v"))
    posted = posted.select("id", "n", F.col("_v.key").alias("key"), F.col("_v.at").alias("at"))
    out = scratch.store(posted.join(classes.select("id", *SKETCH), "id"))
    scratch.drop(each, often)
    return out


def _alike(percent: int) -> F.Column:
    """Set sizes under which the similarity can be reached, and sketches that agree enough.

    Part of the joins of posting lists, so that pairs without a chance never become rows.
    """
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (
        F.col("n_b") * 100 >= F.col("n_a") * percent
    )
    differ = F.lit(0)
    for c in SKETCH:
        bits = F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        differ = differ + F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))
    return sizes & (differ <= SKETCHED - SKETCH_MATCHES)


def _side(lists: DataFrame, x: str) -> DataFrame:
    """Postings as one side of a join."""
    marks = [F.col(c).alias(f"{c}_{x}") for c in ("n", *SKETCH)]
    return lists.select("key", F.col("id").alias(x), *marks)


def _confirmed(
    scratch: Scratch, pairs: DataFrame, text: DataFrame, words: int, percent: int
) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: src, dst, w = 1."""
    # groups of one class and a bounded number of its partners, whatever its degree
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")
    dealt = scratch.store(pairs.join(degree, "a").select("a", "b", part)).df
    own = text.select(F.col("id").alias("a"), "text", "low")
    other = text.select(F.col("id").alias("b"), "text", "low")
    # both sides come from the same tables; names of their own keep the columns apart
    ones = dealt.select("a", "part").distinct().join(own, "a").toDF("a", "part", "text", "low")
    ones = ones.select(*[F.col(c).alias(f"own_{c}") for c in ones.columns])
    others = dealt.join(other, "b").select(
        "a", "part", "b", F.col("text").alias("text"), F.col("low").alias("low")
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        shingler = Shingler(words)

        def sets(texts: pa.ChunkedArray, keys: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
            # a locator that a join repeated may bring several texts: the class is one of them
            for row, (text, key) in enumerate(zip(texts, keys)):
                found = shingler(text.as_py())
                if _key(found)[1] == key.as_py():
                    yield row, found

        src, dst = [], []
        mine = next(sets(left.column("own_text"), left.column("own_low")), None)
        if mine is not None:
            for row, theirs in sets(right.column("text"), right.column("low")):
                both = np.intersect1d(mine[1], theirs, assume_unique=True).size
                if 100 * both >= percent * (len(mine[1]) + len(theirs) - both):
                    src.append(right.column("a")[row].as_py())
                    dst.append(right.column("b")[row].as_py())
        return pa.table(
            {
                "src": pa.array(src, pa.int64()),
                "dst": pa.array(dst, pa.int64()),
                "w": pa.array(np.ones(len(src))),
            }
        )

    return (
        ones.groupBy("own_a", "own_part")
        .cogroup(others.groupBy("a", "part"))
        .applyInArrow(compare, "src long, dst long, w double")
    )


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    percent: int = PERCENT,
) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row each.

    ``component_id`` is the smallest doc_id that is reachable over links, null if all are;
    ``kept`` marks the rows of the component that have this id, and one row if it is null.
    Components that aren't linked have the same ``component_id`` if their smallest doc_id is
    the same.
    """
    places = texts_of(located(Scratch(docs.sparkSession, "near-dedup"), docs))
    placed = _placed(places, words, coordinates, matches, percent)
    return placed.select("doc_id", "n_shingles", "component_id", "kept")


def _placed(
    places: DataFrame,
    words: int = WORDS,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    percent: int = PERCENT,
) -> DataFrame:
    """The rows of ``near_duplicates`` with the file and row of ``places``."""
    spark = places.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    whole = places.withColumn("text", F.coalesce("text", F.lit("")))
    sets = scratch.store(_sets(whole, words, coordinates))
    linked = sets.df.where("n_shingles > 0")
    # the document with the smallest doc_id stands for a class, which goes by its number
    best = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "number")).alias("best")
    classes = scratch.store(
        linked.groupBy("high", "low").agg(best).withColumn("id", F.col("best.number"))
    )
    # copies of a class stand behind this document, so they needn't go any further
    first = classes.df.select("id").join(linked, F.col("id") == F.col("number"))
    signed = scratch.store(
        first.select(
            "id", F.col("n_shingles").alias("n"), "low", "signature", *SKETCH, "bits", "file", "row"
        )
    ).df
    posted = _postings(scratch, signed, matches).df
    involved = posted.select("id").distinct().join(signed.select("id", "low", "file", "row"), "id")
    text = scratch.store(
        whole.drop("doc_id").join(involved, ["file", "row"]).select("id", "text", "low")
    ).df

    found = None
    for hub in (F.min("id"), F.max("id")):
        lists = posted if found is None else _still_open(scratch, posted, merged)
        pairs = _to_hubs(lists, hub, percent)
        some = scratch.store(pairs).df
        edges = scratch.store(_confirmed(scratch, some, text, words, percent)).df
        found = edges if found is None else found.unionByName(edges)
        merged = _components(scratch, found, signed).df

    lists = _still_open(scratch, posted, merged)
    rest = scratch.store(_across(scratch, lists, signed, percent, matches)).df
    more = scratch.store(_confirmed(scratch, rest, text, words, percent))
    if more.rows:
        merged = _components(scratch, found.unionByName(more.df), signed).df

    members = scratch.store(
        classes.df.join(merged, "id").select(F.struct("high", "low").alias("key"), "comp", "best")
    )
    heads = scratch.store(
        members.df.groupBy("comp")
        .agg(F.min("best").alias("best"))
        .select(
            F.col("comp").alias("id"),
            F.col("best.doc_id").alias("component_id"),
            F.col("best.number").alias("stays"),
        )
    )
    values = {c: c for c in ("component_id", "stays")}
    whole = scratch.store(
        lookup(
            members.df.select("key", "comp"), members.rows, "comp", heads.df, heads.rows, values, _LIMITS
        ).select(F.col("key").alias("id"), *values)
    )
    keyed = scratch.store(
        sets.df.select(
            "doc_id", "file", "row", "n_shingles", "number", F.struct("high", "low").alias("set_key")
        )
    )
    placed = lookup(keyed.df, keyed.rows, "set_key", whole.df, whole.rows, values, _LIMITS)
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    stays = (F.col("component_id") == F.col("doc_id")) | (F.col("stays") == F.col("number"))
    kept = (F.col("n_shingles") == 0) | F.coalesce(stays, F.lit(False))
    return placed.select(
        "doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept"), "file", "row"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stand for their component, with all their columns."""
    scratch = Scratch(docs.sparkSession, "near-dedup-kept")
    places = located(scratch, docs)
    stays = _placed(texts_of(places)).where("kept").select("file", "row")
    return places.join(stays, ["file", "row"], "left_semi").select("document.*")


# a look-up table that is broadcast has at most so many rows of a few numbers
_LIMITS = Limits(broadcast_rows=20_000, pointer_rows=20_000, finish_edges=20_000)


def _components(scratch: Scratch, edges: DataFrame, classes: DataFrame):
    """(id, comp) of every class, also of those without links."""
    return scratch.store(connected_components(edges, classes.select("id"), _LIMITS))


def _to_hubs(lists: DataFrame, hub, percent: int) -> DataFrame:
    """(a, b): each class of a list with the class that ``hub`` picks from it."""
    hubs = lists.groupBy("key").agg(hub.alias("a"))
    hubs = hubs.join(_side(lists, "a"), ["key", "a"])
    met = _side(lists, "b").join(hubs, "key").where((F.col("a") != F.col("b")) & _alike(percent))
    return met.select("a", "b").distinct()


def _still_open(scratch: Scratch, posted: DataFrame, merged: DataFrame) -> DataFrame:
    """The lists with several components: (key, id, n, comp)."""
    labelled = scratch.store(posted.join(merged, "id")).df
    mixed = (
        labelled.groupBy("key")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .where("lo < hi")
    )
    return scratch.store(labelled.join(mixed.select("key"), "key", "left_semi")).df


def _across(
    scratch: Scratch, lists: DataFrame, signed: DataFrame, percent: int, matches: int
) -> DataFrame:
    """(a, b) once for all classes of a list that are in different components and agree in
    at least ``matches`` coordinates."""
    own = scratch.store(lists.select("key", "at", "id", "comp"))
    sizes = own.df.groupBy("key").agg(
        F.count(F.lit(1)).alias("often"), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).alias("blocks")
    )
    sizes = scratch.store(sizes).df
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("mine")
    cut = attach_groups(own.df, sizes, "key", "often", own.rows).select("*", mine)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select(
        "key",
        "at",
        "id",
        "comp",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        (F.col("mine") > F.col("other")).alias("second"),
    )
    posted = own.df.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("posted"))
    marks = signed.select("id", "n", "signature", *SKETCH, "bits").join(posted, "id")
    met = cut.join(marks, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            new = _new_list(table)
            cut_at = int(np.flatnonzero(new)[-1])
            if cut_at:
                yield from _pairs(table.slice(0, cut_at), percent, matches)
            held = table.slice(cut_at).to_batches()
        if held:
            yield from _pairs(pa.Table.from_batches(held), percent, matches)

    return met.mapInArrow(run, "a long, b long")


def _new_list(table: pa.Table) -> np.ndarray:
    """Rows that begin a list, or a pair of its blocks."""
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = False
    for c in ("key", "i", "j"):
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _pairs(table: pa.Table, percent: int, matches: int) -> Iterator[pa.RecordBatch]:
    """The pairs of whole lists that qualify, each under its first shared posting."""
    ids, comp, n, at, posted = (
        table.column(c).to_numpy() for c in ("id", "comp", "n", "at", "posted")
    )
    second, crosses = table.column("second").to_numpy(), table.column("i").to_numpy() != table.column("j").to_numpy()
    sketch = np.stack([table.column(c).to_numpy().view(np.uint64) for c in SKETCH], axis=1)
    maps = table.column("bits").cast(pa.binary(BITMAP_BYTES)).combine_chunks()
    bits = np.frombuffer(maps.buffers()[1], dtype=np.uint64).reshape(-1, BITMAP_BYTES // 8)
    bits = bits[maps.offset : maps.offset + len(maps)]
    flat = table.column("signature").combine_chunks().flatten().to_numpy()
    values = flat.reshape(table.num_rows, -1)
    starts = np.flatnonzero(_new_list(table))
    ends = np.append(starts[1:], table.num_rows)
    partners = np.repeat(ends, ends - starts) - np.arange(table.num_rows) - 1
    total = np.concatenate([[0], np.cumsum(partners)])
    lowest = np.uint64(0x1111111111111111)
    row = 0
    while row < table.num_rows:
        stop = max(row + 1, int(np.searchsorted(total, total[row] + PAIR_ROWS, "right")) - 1)
        own = partners[row:stop]
        a = np.repeat(np.arange(row, stop), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[row:stop] - total[row], own)
        row = stop
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        keep = (comp[a] != comp[b]) & (100 * small >= percent * large)
        keep &= ~crosses[a] | (second[a] != second[b])
        a, b = a[keep], b[keep]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        keep = differ * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
        a, b = a[keep], b[keep]
        other = sketch[a] ^ sketch[b]
        other |= other >> np.uint64(2)
        other |= other >> np.uint64(1)
        apart = np.bitwise_count(other & lowest).sum(axis=1, dtype=np.int64)
        keep = apart <= SKETCHED - SKETCH_MATCHES
        a, b = a[keep], b[keep]
        same = values[a] == values[b]
        coordinate = np.arange(values.shape[1])
        both = (posted[a] & posted[b])[:, None] >> coordinate & 1 == 1
        keep = (same.sum(axis=1) >= matches) & ((same & both).argmax(axis=1) == at[a]) & (at[a] == at[b])
        a, b = ids[a[keep]], ids[b[keep]]
        if len(a):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
            )
