"""Toxicity by a bidirectional gated recurrent network with attention pooling (``gru``).

The network is trained in numpy, in one task, from a bounded sample of labelled documents; only its
weights come back. Every document is then scored over all overlapping windows of its whole text, and its score follows from
the highest window.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import gru
from tidelog.llm.common import arrow_schema, fold, labelled_texts, table

THRESHOLD = 0.7
#: Training documents of each class at most, and bytes and words of either class at most (whole documents up to there).
PER_CLASS, CLASS_BYTES, CLASS_WORDS = 3000, 16 << 20, 1_200_000
#: Training windows overlap less than those that are scored: a passage then stands whole in fewer of them.
TRAIN_STRIDE = 48
EPOCHS, SEED = 5, 11


def fit(rows: list[tuple[int, int, str]], epochs: int = EPOCHS, seed: int = SEED) -> tuple[gru.Weights, float, float]:
    """``(doc_id, label, text)`` rows to weights, and the scale and offset that turn a logit into a score.

    Every fifth document is kept out of training and places the threshold. Without both classes the
    score is a constant: the only label there is, or 0 without any.
    """
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    classes = {label for _, label, _ in rows}
    if len(classes) < 2:
        return gru.initial(seed), 0.0, 6.0 if classes == {1} else -6.0
    numbers: dict[bytes, int] = {}
    taken, left = [], {c: CLASS_WORDS for c in classes}
    for doc_id, label, text in rows:
        words = gru.words_of(text)
        if left[label] > 0:
            left[label] -= len(words)
            taken.append((label, np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)))
    vocabulary = list(numbers)
    blocks, apart = ([gru.windows_of(n, gru.WINDOW, stride) for _, n in taken] for stride in (gru.STRIDE, TRAIN_STRIDE))
    labels = np.array([label for label, _ in taken])
    held = np.arange(len(taken)) % 5 == 4
    if any(not np.any((labels == c) & ~held) for c in (0, 1)):
        held[:] = False
    own = np.flatnonzero(~held)
    windows = np.concatenate([apart[i] for i in own])
    owner = np.concatenate([np.full(len(apart[i]), k) for k, i in enumerate(own)])
    w = gru.train(windows, owner, labels[own], vocabulary, epochs, seed)
    every = gru.score(w, np.concatenate(blocks), vocabulary)
    best = np.maximum.reduceat(every, np.cumsum([0, *map(len, blocks)])[:-1])
    unseen = held if all(np.sum((labels == c) & held) >= 8 for c in (0, 1)) else np.ones(len(labels), bool)
    return w, 1.0, _offset(best[unseen], labels[unseen])


def _offset(z: np.ndarray, labels: np.ndarray) -> float:
    """What to add to a logit so that the best cut between the classes scores ``THRESHOLD``."""
    order = np.argsort(z)
    z, y = z[order], labels[order]
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    alarms = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / max(1, (1 - y).sum())
    cost = missed + 4 * alarms  # clean documents must stay
    good = np.flatnonzero(cost <= cost.min() + 1e-9)
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - cuts[good[len(good) // 2]])


SCORED = T.StructType([T.StructField("score", T.DoubleType())])


def scored(docs: DataFrame, model: tuple[gru.Weights, float, float]) -> DataFrame:
    """``docs`` with a column ``score``; null and empty texts score like any text without words."""
    w, scale, offset = model
    name = "score"
    schema = T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])
    kept = [f.name for f in schema.fields[:-1]]
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        scorer = gru.Scorer(w)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                z = scorer.logits(part.column(kept.index("text")).to_pylist()).astype(np.float64)
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-(scale * z + offset))))], schema=arrow)

    return docs.select(*kept).mapInArrow(run, schema)


def model_of(docs: DataFrame, labels: DataFrame) -> tuple[gru.Weights, float, float]:
    """Trained on rows whose crc32 of the id modulo 3 is not 1, ``2 * PER_CLASS`` of them at most."""

    def run(batches):
        import pyarrow as pa

        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    sample = labelled_texts(docs, labels, "toxic", 3, 1, PER_CLASS, CLASS_BYTES).select("doc_id", "label", "text")
    made = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts score like any text without words. Labels with a null id or value are left out, those of one id count with the largest. A null id is
    not held out. Repeated rows come out as often as they went in; empty tables give no rows, and
    without labels of both classes the score is a constant. Columns other than ``doc_id`` and ``text``
    play no part.
    """
    rows = scored(docs.select("doc_id", "text"), model_of(docs, labels))
    return rows.select(
        "doc_id",
        F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with its columns."""
    own = docs.withColumnRenamed("score", "_score")  # a column of theirs may have that name
    kept = scored(own, model_of(docs, labels)).where(F.col("score") < THRESHOLD).drop("score")
    return kept.withColumnRenamed("_score", "score").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
