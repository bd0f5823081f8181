from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """A log from ``(key, seq, value or None)`` triples; None is a tombstone."""
    from tidelog.schema import LOG

    def make(*rows):
        return spark.createDataFrame([(k.encode(), s, int(v is not None), None if v is None else v.encode()) for k, s, v in rows], LOG)

    return make


def pairs(df):
    return [(bytes(r.user_key).decode(), bytes(r.value).decode()) for r in df.collect()]
