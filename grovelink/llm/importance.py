"""Importance resampling of documents towards a target collection.

Two passes over the texts, both with Arrow kernels inside tasks. The first counts hashed
features: words are lower-cased, split and numbered by a dictionary; shifted word numbers
form n-grams, each distinct pair of a shorter n-gram and a word is joined and hashed
(CRC-32) once a batch, and a task gives one row per bucket that it has seen. The counts of
the documents and of the target, at most ``buckets`` numbers each, give the gain of a bucket:
the logarithm of how much likelier the target is to hold it. The second pass takes
the gains along the same numbers and reduces them by text. A score adds Gumbel noise drawn
from the doc_id, so the documents with the highest scores are a sample without replacement.

Ranks come from one range sort over rows of numbers. Texts aren't shuffled.

Defined cases: a null or empty text has no words, no features and weight 0; a target without
words gives every bucket the gain of an empty target; a null doc_id draws its noise from
the empty text and comes last among ties; rows that share a doc_id are separate
documents; ties of score and doc_id go by weight and number of features; an
empty table gives an empty table; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import assign_ids
from ..scratch import Scratch
from .common import small_batches
from .words import Words, located, split_words, texts_of

BUCKETS, LONGEST = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, "2024"


def hashed_ngrams(words: Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every run of n words inside a text, for n = 1, 2, ... ``longest``."""
    width = len(words.dictionary)
    at, ends, rows = np.arange(len(words.codes)), words.ends, words.rows
    codes, grams = words.codes, words.dictionary
    for n in range(1, longest + 1):
        if n > 1:
            fits = at + n <= ends
            at, ends, rows, codes = at[fits], ends[fits], rows[fits], codes[fits]
            pairs, codes = np.unique(codes * width + words.codes[at + n - 1], return_inverse=True)
            grams = pc.binary_join_element_wise(
                grams.take(pa.array(pairs // max(width, 1))),
                words.dictionary.take(pa.array(pairs % max(width, 1))),
                " ",
            )
        crcs = [zlib.crc32(g) % buckets for g in grams.cast(pa.binary()).to_pylist()]
        yield rows, np.array(crcs, dtype=np.int64)[codes]


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all ``texts`` (text STRING): ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, found in hashed_ngrams(split_words(batch.column(0)), longest, buckets):
                seen += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bucket", "n"])

    counted = (
        texts.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most ``buckets`` rows
    )
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the documents))."""
    size = len(documents)
    all_docs, all_target = int(documents.sum()) + size, int(target.sum()) + size
    return np.array(
        [
            math.floor(1000.0 * math.log(float((t + 1) * all_docs) / float((s + 1) * all_target)))
            for s, t in zip(documents.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def _weights(texts: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column(1))
            total = np.zeros(batch.num_rows, dtype=np.int64)
            count = np.zeros(batch.num_rows, dtype=np.int64)
            for rows, found in hashed_ngrams(words, longest, len(gains)):
                # the words of a text lie together: its sum is a difference of running sums
                running = np.concatenate([[0], np.cumsum(gains[found])])
                here = np.bincount(rows, minlength=batch.num_rows)
                ends = np.cumsum(here)
                total += running[ends] - running[ends - here]
                count += here
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in (0, 2, 3)),
                    pa.array(words.counts),
                    pa.array(count),
                    pa.array(total // np.maximum(count, 1)),
                ],
                names=["doc_id", "file", "row", "n_words", "n_features", "weight"],
            )

    return texts.mapInArrow(
        run, "doc_id long, file string, row long, n_words long, n_features long, weight long"
    )


def _drawn(
    scratch: Scratch,
    places: DataFrame,
    target: DataFrame,
    percent: int,
    least_words: int,
    longest: int,
    buckets: int,
    seed: str,
) -> DataFrame:
    texts = texts_of(places)
    gains = bucket_gains(bucket_counts(texts, longest, buckets), bucket_counts(target, longest, buckets))
    text_of_id = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text_of_id, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    enough = (F.col("n_words") >= least_words).alias("enough")
    scored = scratch.store(
        _weights(texts, gains, longest).select("*", (F.col("weight") + noise).alias("score"), enough),
        eligible=F.sum(F.col("enough").cast("long")),
    )
    quota = percent * (scored.metrics["eligible"] or 0) // 100
    ordered = assign_ids(
        scored.df,
        F.desc("enough"),
        F.desc("score"),
        F.col("doc_id").asc_nulls_last(),
        F.desc("weight"),
        F.desc("n_features"),
        id_col="at",
    )
    # those with enough words come first, so the quota never reaches the others
    return ordered.withColumn("rank", F.when(F.col("at") < quota, F.col("at") + 1))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """docs(doc_id, text, ...), target(text, ...) -> doc_id, n_words, n_features, weight,
    score, rank; one row per document.

    ``rank`` counts the drawn documents from 1 in order of their score and is null for the
    others. ``percent`` of the documents with at least ``least_words`` words are drawn.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "importance")
    done = _drawn(
        scratch, located(scratch, docs), target, percent, least_words, longest, buckets, seed
    )
    return done.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; options as for ``resample``."""
    values = {
        "percent": PERCENT, "least_words": LEAST_WORDS, "longest": LONGEST, "buckets": BUCKETS, "seed": SEED,
    } | options
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "importance")
    places = located(scratch, docs)
    stays = _drawn(scratch, places, target, **values).where("rank IS NOT NULL")
    return places.join(stays.select("file", "row"), ["file", "row"], "left_semi").select("document.*")
