"""The driver tables as logs; string keys, so that results compare as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _log(df: DataFrame, key: Column, seq: Column, dead: Column, value: Column, *more: Column) -> DataFrame:
    kind = F.when(dead, 0).otherwise(1)
    return df.select(key.alias("user_key"), seq.cast("long").alias("seq"), kind.cast("byte").alias("type"), F.when(~dead, value).alias("value"), *more)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user: the type of an event is the value, an error deletes."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _log(df, F.format_string("user:%08d", "user_id"), F.col("event_id") + 1, F.col("event_type") == "error", F.col("event_type"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer: the priority is the value, a finished order deletes."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _log(df, F.format_string("cust:%08d", "o_custkey"), F.col("o_orderkey") + 1, F.col("o_orderstatus") == "F", F.col("o_orderpriority"))


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by conversation; sequences count within a conversation only."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return _log(df, F.format_string("conv:%08d", "conv_id"), F.col("turn") + 1, F.lit(False), F.col("role"))


def with_runs(log: DataFrame, size: int) -> DataFrame:
    """``log`` cut into runs of ``size`` sequences, as flushes would have written them."""
    return log.withColumn("run_id", F.floor((F.col("seq") - 1) / size).cast("long"))
