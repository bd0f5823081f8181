"""A corpus from raw documents to token records: five stages, each written as Parquet and read again.

Counted as part of the ``llm`` subpackage. Every stage works on all rows its predecessor kept. The first
four return the columns of their ``docs``, whatever these are called, and take nulls in any of them; null
texts count as empty ones. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, mixing, records, simhash, toxicity
from tidelog.llm.common import settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold.

    Null and empty texts score like any text without words. Repeated rows score alike and stay or go together.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, that with the smallest id.

    Of rows that share that id the first by text stays, so repeated rows become one. Null and empty texts
    are one group; rows with a null id link nothing and all stay.
    """
    return simhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none. Repeated rows stay or go together. Items without words match nothing.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is one of its own. Documents without words stay once. Repeated rows count each, and rows
    that are equal throughout are interchangeable where one of them gets a copy more.
    """
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records in ascending order of ids: one row for each document and copy, read back from the files.

    Null and empty texts give the end id alone. Null ids come first; of equal ids the order follows from a
    hash of the text.
    """
    return records.encoded(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("token_records", write_tokens),
]

#: SQL can't train the network or pair off fingerprints; the tests hold the pipeline against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
