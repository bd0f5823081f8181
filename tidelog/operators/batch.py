"""Write batches: ordered lists of puts and deletes that get consecutive sequence numbers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.schema import DELETE, LOG, PUT, InvalidArgument
from tidelog.sources.scratch import scratch_folder


class Handler(Protocol):
    def put(self, key: bytes, value: bytes) -> None: ...

    def delete(self, key: bytes) -> None: ...


@dataclass
class WriteBatch:
    """Operations in order. Applied as one: all become visible, or none."""

    ops: list[tuple[int, bytes, bytes | None]] = field(default_factory=list)

    def put(self, key: bytes, value: bytes) -> "WriteBatch":
        self.ops.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> "WriteBatch":
        self.ops.append((DELETE, bytes(key), None))
        return self

    def clear(self) -> None:
        self.ops.clear()

    def append(self, other: "WriteBatch") -> "WriteBatch":
        self.ops.extend(other.ops)
        return self

    def __len__(self) -> int:
        return len(self.ops)

    def iterate(self, handler: Handler) -> None:
        for kind, key, value in self.ops:
            if kind == PUT:
                handler.put(key, value)
            elif kind == DELETE:
                handler.delete(key)
            else:
                raise InvalidArgument(f"unknown operation {kind}")

    def encoded(self, first: int) -> bytes:
        """The batch in its binary form, its records numbered from ``first``."""
        from tidelog.sources.interchange import encoded_batch

        return encoded_batch(self.sequenced(first))

    @staticmethod
    def decoded(data: bytes) -> "WriteBatch":
        from tidelog.sources.interchange import batch_rows

        return WriteBatch([(kind, key, value) for key, _, kind, value in batch_rows(data)])

    def sequenced(self, first: int) -> list[tuple[bytes, int, int, bytes | None]]:
        return [(key, first + n, kind, value) for n, (kind, key, value) in enumerate(self.ops)]

    def frame(self, spark: SparkSession, first: int) -> DataFrame:
        return spark.createDataFrame(self.sequenced(first), LOG)


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """Batches as rows ``batch_id, place, ...``: those of ``second`` behind those of ``first`` with the same id.

    Places only order the operations of a batch. An aggregate of one row a batch; no operation is collected.
    """
    after = first.groupBy("batch_id").agg((F.max("place") + 1).alias("_after"))
    moved = second.join(after, "batch_id", "left").withColumn("place", F.col("place") + F.coalesce("_after", F.lit(0))).drop("_after")
    return first.unionByName(moved)


def exploded(batches: DataFrame, base: int = 0) -> DataFrame:
    """Log rows of ``batches(batch_id, ops array<struct<type, key, value>>)`` in the order of ``batch_id``.

    An empty batch uses no number. Batches are sorted into ranges of ids and written once with the number
    of operations before each in its range; the ranges' sums, a row each, give the rest.
    """
    spark = batches.sparkSession
    ranged = batches.repartitionByRange("batch_id").withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.select("_part", "batch_id", F.size("ops").cast("long").alias("n"))
    folder = scratch_folder(spark, "batches")
    sizes.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).write.parquet(folder)
    placed = spark.read.parquet(folder)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.sum("n").alias("n"))
    bases = sums.select("_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + base + 1).alias("base"))
    starts = placed.join(F.broadcast(bases), "_part").select("batch_id", (F.col("base") + F.col("first")).alias("first"))  # a row for each range
    rows = batches.join(starts, "batch_id").select("batch_id", "first", F.posexplode("ops").alias("place", "op"))
    return rows.select("batch_id", (F.col("first") + F.col("place")).alias("seq"), F.col("op.type").alias("type"), F.col("op.key").alias("user_key"), F.col("op.value").alias("value"))


def sequence_rows(staged: DataFrame, base: int, ordinal: str = "_ordinal") -> DataFrame:
    """Consecutive ``seq`` from ``base + 1`` for rows with an ordinal of ``monotonically_increasing_id``.

    ``staged`` must be stored, so that ordinals do not change. Counts by partition, one row each, give the
    offsets; no window runs over the rows.
    """
    part = F.shiftright(F.col(ordinal), 33)
    counts = staged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col(ordinal).bitwiseAND(F.lit((1 << 33) - 1))
    return staged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("seq", F.col("_offset") + place + base + 1).drop("_part", "_offset", ordinal)
