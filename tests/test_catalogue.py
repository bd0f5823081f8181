"""Every query of the catalogue against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tidelog.operators import compaction
from tidelog.plans import catalogue, stored  # noqa: F401  (both register queries)
from tidelog.schema import MAX_LONG, Options

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(str([None if pd.isna(v) else v for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    assert rows(got) == rows(duck.sql(catalogue.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_level_capacity_saturates():
    assert [compaction.level_capacity(n, Options(max_level_bytes=10)) for n in range(4)] == [0, 10, 100, 1000]
    assert compaction.level_capacity(100, Options()) == MAX_LONG


def test_throttle():
    options = Options(max_write_amplification=1, l0_compaction_trigger=4, backlog_factor=0)
    assert compaction.throttled(100, 100, 3, options) and not compaction.throttled(100, 100, 16, options)
    assert not compaction.throttled(99, 100, 3, options)


def test_pressure_must_exceed_one_and_the_last_level_stays(spark):
    options = Options(max_num_levels=3, l0_compaction_trigger=4, max_level_bytes=10)
    stats = lambda *r: spark.createDataFrame([(n, f, b) for n, (f, b) in enumerate(r)], "level int, files long, bytes long")
    pick = lambda *r: [x.level for x in compaction.pick_level(stats(*r), options).collect()]
    assert pick((4, 0), (1, 10), (1, 10**6)) == []
    assert pick((5, 0), (1, 10), (1, 0)) == [0]
    assert pick((8, 0), (2, 20), (1, 0)) == [0]
    assert pick((5, 0), (2, 20), (1, 0)) == [1]
