"""Reliable intermediate tables.

Iterative operators cut their lineage by writing a Parquet table to the shared
folder that the cluster names in ``spark.checkpoint.dir`` and reading it back.
Such a table outlives any executor, is columnar (later steps read only the
columns they need), is computed once, and has true size statistics: a chain of
``checkpoint()`` frames instead multiplies join estimates from round to round.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only for local sessions without it."""
    conf = spark.sparkContext.getConf()
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or conf.get("spark.checkpoint.dir")
        or spark.sparkContext.getCheckpointDir()
    )
    if root:
        return root
    if not (conf.get("spark.master") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="grovelink-")
    return _local_roots[app]


@dataclass(frozen=True)
class Stored:
    """A table written to the scratch folder, with the counts taken while writing it."""

    df: DataFrame
    rows: int
    path: str
    metrics: dict = field(default_factory=dict)


class Scratch:
    """A private sub-folder of the scratch root for one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{scratch_root(spark).rstrip('/')}/grovelink/{name}-{uuid.uuid4().hex}"
        self._next = 0

    def store(
        self, df: DataFrame, hide: tuple[str, ...] = (), small: bool = False, **metrics: Column
    ) -> Stored:
        """Write ``df`` once; row count and ``metrics`` are observed by the same job.

        Columns in ``hide`` feed the metrics only and are not written. ``small``
        says that the caller knows a low bound on the rows: one file is enough.
        """
        self._next += 1
        path = f"{self.folder}/{self._next:04d}"
        seen = Observation()
        watched = df.observe(
            seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]
        )
        kept = watched.drop(*hide) if hide else watched
        (kept.coalesce(1) if small else kept).write.parquet(path)
        table = self.spark.read.schema(kept.schema).parquet(path)
        values = dict(seen.get)
        rows = values.pop("rows", None)
        if rows is None:
            rows = table.count()
        return Stored(table, rows, path, values)

    def drop(self, *tables: Stored | None) -> None:
        """Remove tables of finished rounds that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            if table is not None and table.path and table.path.startswith(self.folder):
                path = jvm.org.apache.hadoop.fs.Path(table.path)
                path.getFileSystem(conf).delete(path, True)
