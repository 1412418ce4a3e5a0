"""Words of whole texts with Arrow kernels, and a place for every document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

# fixed value: what separates words once A-Z are lower-cased
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Words:
    """The words of a batch of texts, text after text.

    ``codes``: the number of each word in ``dictionary``; ``starts``: where each text begins,
    and one entry more for the end of the last.
    """

    codes: np.ndarray
    starts: np.ndarray
    dictionary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def rows(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    @property
    def ends(self) -> np.ndarray:
        """For each word, where its text ends."""
        return np.repeat(self.starts[1:], self.counts)


def split_words(texts: pa.Array) -> Words:
    """Lower-case A-Z, cut at the separators; a null text has no words."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    flat, parents = pc.list_flatten(parts), pc.list_parent_indices(parts)
    # a separator at either end leaves an empty part
    real = pc.greater(pc.binary_length(flat), 0)
    encoded = flat.filter(real).dictionary_encode()
    counts = np.bincount(parents.filter(real).to_numpy(), minlength=len(texts))
    return Words(
        encoded.indices.to_numpy().astype(np.int64),
        np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
        encoded.dictionary,
    )


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def boxed(docs: DataFrame) -> Column:
    return F.struct(*[named(c).alias(c) for c in docs.columns]).alias("document")


def _is_scan(docs: DataFrame) -> bool:
    if any(c.lower() == "_metadata" for c in docs.columns):
        return False
    try:
        docs.select("_metadata.row_index")
        return True
    except AnalysisException:
        return False


def located(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(document STRUCT, file, row): the rows of ``docs`` and the place that names each.

    Rows of a plain file scan stay where they are; any other frame is written first.
    """
    one = docs.select(boxed(docs), "_metadata") if _is_scan(docs) else None
    if one is None:
        one = scratch.store(docs.select(boxed(docs))).df.select("document", "_metadata")
    return one.select(
        "document",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def texts_of(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id LONG, text STRING, file, row) of located documents."""
    return found.select(
        F.col(f"document.{key}").cast("long").alias(key),
        F.col("document.text").cast("string").alias("text"),
        "file",
        "row",
    )
