"""Exact deduplication with streaming state, in DataFrame operations only.

Arriving documents are noted in an inbox: digest of the normalised text, stable identifier
(doc_id) and content locator (file and row). A Structured Streaming query folds the inbox
into keyed state on disk (RocksDB, no watermark, so nothing expires): per digest the
identifier and locator of the row that stays and the number of rows. More documents can be
added to the same state later; only new inbox files are read then.

A digest that was met twice is a hit. The texts of all hits, also those of rows that an
earlier call added to the state, are fetched by their locators and compared byte by byte with
the text that stays; so the files of earlier calls have to stay where they are. Rows whose bytes differ although the
digest agrees are grouped again by the text itself.

Defined cases: a null text is empty; a null doc_id is smaller than any other; of rows with
equal (text, doc_id) the one with the largest locator stays, so exactly one row of a group
has kept = true; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import attach_groups
from .words import located, texts_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# keys in a partition of a new state, as a mean
STATE_ROWS = 10_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _located(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, file, row): a frame that isn't a plain file scan is written first."""
    pick = [
        F.col("doc_id").cast("long").alias("doc_id"),
        normalised(F.col("text")).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ]
    try:
        return docs.select(*pick)
    except AnalysisException:
        return scratch.store(docs.select("doc_id", "text")).df.select(*pick)


class DedupState:
    """Keyed state in a shared folder; the same folder can be opened again."""

    def __init__(
        self, spark: SparkSession, folder: str | None = None, partitions: int = 8
    ):
        """``partitions`` is fixed by the first use of a folder: a state can't be dealt anew
        later, so it is chosen by the number of keys to come, not by the session's setting
        for shuffles. Each has a database of its own with a fixed cost of some megabytes.
        """
        self.spark = spark
        self.folder = folder or Scratch(spark, "dedup-state").folder
        self.partitions = partitions

    def arrivals(self) -> DataFrame | None:
        """What was added so far; later additions aren't part of it."""
        try:
            return self.spark.read.parquet(f"{self.folder}/inbox")
        except AnalysisException:
            return None

    def add(self, arrivals: DataFrame) -> None:
        """arrivals(doc_id, digest, file, row) join the state."""
        inbox = f"{self.folder}/inbox"
        arrivals.write.mode("append").parquet(inbox)
        session = self.spark.newSession()
        for key, value in {
            "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
            "spark.sql.streaming.noDataMicroBatches.enabled": "false",
            "spark.sql.streaming.internal.stateStore.partitions": str(self.partitions),
        }.items():
            session.conf.set(key, value)
        source = session.readStream.schema(arrivals.schema).parquet(inbox)
        folded = source.groupBy("digest").agg(
            F.max(F.struct("doc_id", "file", "row")).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        )
        query = (
            folded.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", f"{self.folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def groups(self) -> DataFrame:
        """(digest, keep_id, keep_file, keep_row, group_size), read from the state store."""
        state = self.spark.read.format("statestore").load(f"{self.folder}/state")
        best, size = (F.col(f"value.{c}") for c in state.schema["value"].dataType.names)
        return state.select(
            F.col("key.digest").alias("digest"),
            best["doc_id"].alias("keep_id"),
            best["file"].alias("keep_file"),
            best["row"].alias("keep_row"),
            size.alias("group_size"),
        )


def deduplicate(
    docs: DataFrame, digest=sha256, state_folder: str | None = None
) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, keep_id, group_size, kept, digest, one row each.

    ``digest`` maps the normalised text to the key of the state; any function will do for
    right results, a good one avoids comparing texts in vain.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    return _deduplicate(scratch, _located(docs, scratch), digest, state_folder)


def _deduplicate(
    scratch: Scratch, rows: DataFrame, digest=sha256, state_folder: str | None = None
) -> DataFrame:
    """The result for rows (doc_id, text, file, row) with normalised texts."""
    spark = scratch.spark
    rows = rows.withColumn("digest", digest(F.col("text")))
    seen = scratch.store(rows.select("doc_id", "digest", "file", "row"))
    if not seen.rows:
        return _result(seen.df.select("*", *_none()))
    state = DedupState(spark, state_folder, max(8, seen.rows // STATE_ROWS))
    before = state.arrivals()
    state.add(seen.df)
    groups, size = state.groups(), "group_size"
    if before is not None:
        # a group of the state may have few rows or none in these documents
        size = "own_size"
        groups = groups.join(seen.df.groupBy("digest").agg(F.count(F.lit(1)).alias(size)), "digest")
    groups = scratch.store(groups)
    joined = attach_groups(seen.df, groups.df, "digest", size, seen.rows).select(
        *seen.df.columns, "keep_id", "keep_file", "keep_row", "group_size"
    )

    hits = groups.df.where("group_size > 1")
    found = rows.withColumn("own", F.lit(True))
    if before is not None:
        found = found.unionByName(_earlier(scratch, before, hits))
    odd, exact = _compared(scratch, found, hits)
    if odd is not None:
        sure = joined.join(odd, "digest", "left_anti")
        joined = sure.unionByName(exact)
    return _result(joined)


def _earlier(scratch: Scratch, before: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of earlier calls that hits are about, with their texts read again."""
    rows = scratch.store(before.join(hits.select("digest"), "digest", "left_semi"))
    files = [unquote(r["file"]) for r in rows.df.select("file").distinct().collect()]
    if not files:
        return rows.df.withColumns({"text": F.lit(""), "own": F.lit(False)})
    texts = scratch.spark.read.parquet(*files).select(
        normalised(F.col("text")).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return rows.df.join(texts, ["file", "row"]).withColumn("own", F.lit(False))


def _none() -> list[Column]:
    kinds = {"keep_id": "long", "keep_file": "string", "keep_row": "long", "group_size": "long"}
    return [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]


def _result(rows: DataFrame) -> DataFrame:
    stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(stays, F.lit(False)).alias("kept"),
        "digest",
        "file",
        "row",
    )


def _compared(
    scratch: Scratch, located: DataFrame, hits: DataFrame
) -> tuple[DataFrame | None, DataFrame | None]:
    """Compare the bytes of every hit with the text that stays.

    Returns the digests under which different texts met, and those rows grouped by their
    texts; (None, None) if there are none, as with any digest of good length. Rows that
    aren't ``own`` count in their groups, but aren't returned.
    """
    # a hot digest is one skewed key of these two sort-merge joins, which Spark splits
    texts = scratch.store(
        located.join(hits.select("digest", "keep_file", "keep_row"), "digest").withColumn(
            "stays", (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        )
    )
    stay = texts.df.where("stays").select("digest", F.col("text").alias("stay_text"))
    differs = (
        texts.df.where("not stays").join(stay, "digest").where(F.col("text") != F.col("stay_text"))
    )
    # no grouping here: it would keep Spark from splitting the skewed key of the join
    found = scratch.store(differs.select("digest"))
    if not found.rows:
        scratch.drop(texts)
        return None, None
    odd = found.df.distinct()
    rows = texts.df.join(odd, "digest", "left_semi").drop("keep_file", "keep_row", "stays")
    best = F.max(F.struct("doc_id", "file", "row"))
    by_text = rows.groupBy("digest", "text").agg(
        best.alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    grouped = rows.where("own").join(by_text, ["digest", "text"]).select(
        *[c for c in ("digest", "doc_id", "file", "row")],
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.file").alias("keep_file"),
        F.col("best.row").alias("keep_row"),
        "group_size",
    )
    return odd, grouped


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exact-dedup-kept")
    places = located(scratch, docs)
    rows = texts_of(places).withColumn("text", normalised(F.col("text")))
    stays = _deduplicate(scratch, rows).where("kept").select("file", "row")
    return places.join(stays, ["file", "row"], "left_semi").select("document.*")
