"""Which level to compact, what goes in, and when to hold back, over run metadata (``RUN_META`` or part of it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import MAX_LONG, Options


def level_capacity(level: int, options: Options) -> int:
    """Bytes a level may hold, saturating; level 0 is bounded by its number of runs instead."""
    if level == 0:
        return 0
    return min(MAX_LONG, options.max_level_bytes * options.max_level_bytes_multiplier ** (level - 1))


def capacity_column(level: Column, options: Options) -> Column:
    grown = F.lit(float(options.max_level_bytes)) * F.pow(F.lit(float(options.max_level_bytes_multiplier)), level - 1)
    return F.when(level == 0, F.lit(0.0)).otherwise(F.least(grown, F.lit(float(MAX_LONG))))


def level_stats(spark: SparkSession, runs: DataFrame, options: Options) -> DataFrame:
    """``level, files, bytes`` with a row for every level, zero where it is empty."""
    sums = runs.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    levels = spark.range(options.max_num_levels).select(F.col("id").cast("int").alias("level"))
    return levels.join(sums, "level", "left").select("level", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def pressures(stats: DataFrame, options: Options) -> DataFrame:
    """``stats`` with ``pressure``: runs by the trigger on level 0, bytes by the capacity below."""
    by_bytes = F.col("bytes") / F.when(F.col("level") > 0, capacity_column(F.col("level"), options))
    return stats.withColumn("pressure", F.when(F.col("level") == 0, F.col("files") / F.lit(float(options.l0_compaction_trigger))).otherwise(by_bytes))


def pick_level(stats: DataFrame, options: Options) -> DataFrame:
    """The level of the greatest pressure, if that is over 1; the lower of equals. The last level has nowhere to go."""
    open_levels = pressures(stats, options).where((F.col("level") < options.max_num_levels - 1) & (F.col("pressure") > 1))
    return open_levels.orderBy(F.col("pressure").desc(), "level").limit(1)


def throttled(compacted: int, written: int, l0_files: int, options: Options) -> bool:
    """Whether compaction has rewritten its share of what users wrote and level 0 is not in arrears."""
    backlog = options.backlog_factor if options.backlog_factor > 0 else 4
    if l0_files >= options.l0_compaction_trigger * backlog:
        return False
    return options.max_write_amplification >= 0 and compacted >= written * options.max_write_amplification


def throttled_column(compacted: Column, written: Column, l0_files: Column, options: Options) -> Column:
    backlog = options.backlog_factor if options.backlog_factor > 0 else 4
    spent = (compacted >= written * options.max_write_amplification) & F.lit(options.max_write_amplification >= 0)
    return spent & (l0_files < options.l0_compaction_trigger * backlog)


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs ``left_id, right_id`` of runs whose ranges of user keys meet, ends included. Run metadata only: few rows."""
    a, b = left.alias("a"), right.alias("b")
    meet = (F.col("a.smallest_key") <= F.col("b.largest_key")) & (F.col("a.largest_key") >= F.col("b.smallest_key"))
    return a.join(b, meet & (F.col("a.run_id") != F.col("b.run_id"))).select(F.col("a.run_id").alias("left_id"), F.col("b.run_id").alias("right_id"))


def inputs(runs: DataFrame, level: int) -> DataFrame:
    """The runs a compaction of ``level`` reads: all of level 0, else the oldest, and what those meet one level down.

    On level 0 the ranges of all runs count together.
    """
    own = runs.where(F.col("level") == level)
    if level:
        own = own.orderBy("run_id").limit(1)
    span = own.agg(F.min("smallest_key").alias("low"), F.max("largest_key").alias("high"))
    below = runs.where(F.col("level") == level + 1).join(F.broadcast(span), (F.col("smallest_key") <= F.col("high")) & (F.col("largest_key") >= F.col("low")))
    return own.unionByName(below.drop("low", "high"))


def earliest_pin(pins: DataFrame, otherwise: int) -> DataFrame:
    """``earliest``: the least pinned sequence of ``pins(seq)``, ``otherwise`` if nothing is pinned."""
    return pins.agg(F.coalesce(F.min("seq"), F.lit(otherwise)).alias("earliest"))


def write_amplification(compacted: Column, written: Column) -> Column:
    return F.try_divide(compacted.cast("double"), written.cast("double"))


def run_metadata(log: DataFrame, run: str = "run_id", order: Callable[[Column], Column] | None = None) -> DataFrame:
    """Count, key range and sequence range of each run in one aggregate; ``order`` is that of the keys, bytewise if None."""
    size = F.sum(F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("file_size")
    key = F.col("user_key")
    low, high = (F.min(key), F.max(key)) if order is None else (F.min_by(key, order(key)), F.max_by(key, order(key)))
    return log.groupBy(run).agg(
        F.count("*").alias("num_entries"), size, low.alias("smallest_key"), high.alias("largest_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )


def approximate_offset(runs: DataFrame, key) -> DataFrame:
    """``offset``: bytes of the runs that lie wholly below ``key``."""
    return runs.agg(F.coalesce(F.sum(F.when(F.col("largest_key") < F.lit(key), F.col("file_size"))), F.lit(0)).alias("offset"))


def memory_usage(log: DataFrame) -> DataFrame:
    """``bytes`` of the records as a write buffer holds them: key, an 8-byte tag, value, and their length prefixes."""
    from tidelog.functions.keys import varint_length

    key = F.octet_length("user_key").cast("long") + 8
    value = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    return log.agg(F.sum(varint_length(key) + key + varint_length(value) + value).alias("bytes"))
