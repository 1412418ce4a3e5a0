"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it
kept, and returns a DataFrame; its result is written as Parquet to the shared folder and
read again as the next one's documents. All but the last return the columns of documents.

Defined cases: those of the operators; a stage that keeps nothing gives the next one an empty
table. Rows that share a doc_id or have none are separate documents. Of a group of near
copies all rows with the smallest doc_id stay, and one row if none of them has a doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelink.llm import exact_dedup, near_dedup, packing, pii, quality
from grovelink.llm.common import table
from grovelink.scratch import Scratch

CAPACITY = 2048
# a demonstration key; a deployment takes its own from its secret store
PII_KEY = b"grovelink pseudonyms"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exact_dedup.kept_documents(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, one with the smallest doc_id."""
    return near_dedup.kept_documents(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms."""
    return pii.pseudonymised_documents(docs, PII_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with ids and places in sequences: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    path = public_tokenizers.path("word_bpe_49k.json")
    # the workers still hold what earlier stages left, so fewer words are remembered here
    pieces = packing.cut_pieces(docs, path, CAPACITY, cache_words=100_000)
    light = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(light, "length", ["doc_id", "piece", "ids_crc32"], CAPACITY)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_contents),
    ("pii", without_personal_data),
    ("packing", packed),
]

# tokenizers, trees and permutations have no SQL form; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir)).df
    return docs
