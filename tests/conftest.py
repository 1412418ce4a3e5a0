import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    session = builder.getOrCreate()
    if not session.sparkContext.getConf().get("spark.checkpoint.dir"):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Small tables: make.edges([...]), make.points([...])."""

    class Make:
        def edges(self, rows):
            return spark.createDataFrame(
                [(int(a), int(b), float(w)) for a, b, w in rows], "src long, dst long, w double"
            )

        def points(self, rows, labels=None):
            data = [
                (i, [float(x) for x in r], float(labels[i]) if labels else None)
                for i, r in enumerate(rows)
            ]
            return spark.createDataFrame(data, "id long, features array<double>, label double")

        def ids(self, ids):
            return spark.createDataFrame([(int(i),) for i in ids], "id long")

    return Make()
