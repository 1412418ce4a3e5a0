"""Helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# a key that holds more than this share of all rows is answered by a broadcast; at
# most HEAVY_SHARE keys can be that heavy, whatever the size of the table
HEAVY_SHARE = 256
# rows and bytes of one Arrow batch: they bound a Python worker's memory when texts are long
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shaped(df: DataFrame, column: str, rest: str) -> StructType:
    """The schema of a column of ``df``, then of those that ``rest`` declares."""
    return StructType([df.schema[column], *StructType.fromDDL(rest)])


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id LONG, text STRING): a null text is an empty one; other columns go."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def attach_groups(
    left: DataFrame, groups: DataFrame, key: str, size: str, total: int
) -> DataFrame:
    """Inner join of ``left`` with ``groups`` (unique on ``key``; ``size`` says how many rows
    of ``left`` each group has, ``total`` how many all have) that no hot group slows down.

    Groups above total / HEAVY_SHARE rows are at most HEAVY_SHARE, so they are broadcast
    and their rows stay where they are; the rest is a shuffle join. ``left`` is read
    twice: store it first.
    """
    is_hot = F.col(size) * HEAVY_SHARE > F.lit(total)
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    hot_keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(
        left.join(hot_keys, key, "left_anti").join(cold, key)
    )


class Recent(dict):
    """Results by short string: the last ``size`` to 2 * ``size`` that were asked for."""

    def __init__(self, make, size: int, longest: int = 48):
        super().__init__()
        self.make, self.size, self.longest = make, size, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
