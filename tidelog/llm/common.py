"""What the operators of this subpackage share: table access, shared storage, labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources.scratch import scratch_folder

#: Rows of one Arrow batch that a kernel turns into Python objects at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and every executor can reach, in ``spark.checkpoint.dir``; see ``scratch_folder``."""
    return scratch_folder(spark, name)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, kernel: Callable[[list], list[tuple]], inputs: list[str], schema: T.StructType) -> DataFrame:
    """Run ``kernel`` over column slices: it gets the lists of ``inputs`` and returns the lists of ``schema``.

    At most ``SLICE`` rows are Python objects at once, whatever the size of the Arrow batch.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = kernel([part.column(i).to_pylist() for i in range(len(inputs))])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.select(*inputs).mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def fold(modulus: int):
    """crc32 of the document id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, class_bytes: int | None = None) -> DataFrame:
    """A bounded training sample: ``doc_id, label, text`` of at most ``per_class`` documents of each class.

    Rows with a null id or label, and those of the held-out fold, are never used. Which ids are taken
    follows from a hash of the id, so reruns agree. An id with several labels counts with the largest,
    an id with several texts with the smallest. With ``class_bytes`` the documents of a class are taken
    whole, in the order of the hash, until they have that many bytes.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    bounded = ids.where("label = 0").orderBy(*order).limit(per_class).unionAll(ids.where("label = 1").orderBy(*order).limit(per_class))
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(bounded), "doc_id")  # 2 * per_class rows of an id and a label at most
        .groupBy("doc_id", "label")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
    if class_bytes is None:
        return texts
    before = Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # per_class rows at most
    return texts.withColumn("_before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("_before") < class_bytes).drop("_before")
