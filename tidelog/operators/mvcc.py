"""Visibility and retention over a log ``(user_key, seq, type, value)``. All functions are DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.keys import pack, unpack
from tidelog.schema import DELETE, MAX_SEQUENCE, PUT


def merged(runs: list[DataFrame]) -> DataFrame:
    """The rows of all runs. Which run holds a record plays no part: visibility follows from ``seq``."""
    first, *rest = runs
    for run in rest:
        first = first.unionByName(run)
    return first


def at(log: DataFrame, snapshot: int | Column | None = None) -> DataFrame:
    """Records up to ``snapshot``, inclusive; the filter reaches the Parquet scan."""
    if snapshot is None or (isinstance(snapshot, int) and snapshot >= MAX_SEQUENCE):
        return log
    return log.where(F.col("seq") <= snapshot)


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """One row a key, its newest record up to ``snapshot``, tombstones included: a map-side combined aggregate."""
    latest = F.max(F.struct("seq", "type", "value")).alias("r")
    return at(log, snapshot).groupBy("user_key").agg(latest).select("user_key", "r.seq", "r.type", "r.value")


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``user_key, value`` of the keys whose newest record up to ``snapshot`` is a put; a tombstone hides all older ones."""
    return newest(log, snapshot).where(F.col("type") == PUT).select("user_key", "value")


def marks(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``user_key, seq, type`` of each key's newest record, for reads that need no values.

    Sequence and type are one number, so this is a hash aggregate (a value in the buffer would make it a
    sort), and the scan does not read ``value``. The number uses all 64 bits, so its top bit is turned
    over while numbers are compared.
    """
    top = F.lit(-(1 << 63))
    packed = at(log, snapshot).groupBy("user_key").agg(F.max(pack(F.col("seq"), F.col("type")).bitwiseXOR(top)).alias("packed"))
    seq, kind = unpack(F.col("packed").bitwiseXOR(top))
    return packed.select("user_key", seq.alias("seq"), kind.alias("type"))


def visible_keys(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``user_key`` of the visible rows."""
    return marks(log, snapshot).where(F.col("type") == PUT).select("user_key")


def tombstones(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Keys hidden by a tombstone, with its ``seq``."""
    return marks(log, snapshot).where(F.col("type") == DELETE).select("user_key", "seq")


def history(log: DataFrame) -> DataFrame:
    """Every record in log order, key ascending and newest first, with its place ``pos`` within the key."""
    order = Window.partitionBy("user_key").orderBy(F.col("seq").desc(), F.col("type").desc())
    return log.withColumn("pos", F.row_number().over(order).cast("long"))


def retained(log: DataFrame, earliest_pin: int, bottom: bool = False) -> DataFrame:
    """What a compaction keeps so that no snapshot from ``earliest_pin`` on changes.

    All records above the pin pass through; the newest at or below it is an aggregate, combined before its
    shuffle, so the versions of a hot key are never sorted in one task. At the bottom level a tombstone that is the
    newest at or below the pin goes too, as nothing older is left for it to hide.
    """
    old = newest(log, earliest_pin)
    if bottom:
        old = old.where(F.col("type") != DELETE)
    return log.select(*old.columns).where(F.col("seq") > earliest_pin).unionByName(old)
