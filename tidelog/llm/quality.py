"""Quality by Bradley-Terry ranking.

A document's worth is linear in features of its text. It is learned from preference pairs, a document
marked good over one marked bad, by logistic loss on the difference of their features. The cut between
good and bad is a quantile of the scores of the training sample; scores are scaled so that it lies at
``THRESHOLD``.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import fold, labelled_texts, map_rows, table

THRESHOLD = 0.3
#: Training documents of each class, pairs of them in one step, steps.
PER_CLASS, PAIRS, STEPS, SEED = 4000, 4096, 600, 7

#: Byte classes of which a text's share is a feature.
CLASSES = (b"#$%&*", b"|", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b" ", b"\n", b"<>{}[]()=/\\_@~^`'\"-+", bytes(range(128, 256)))
_OF = np.zeros((256, len(CLASSES)))
for _n, _c in enumerate(CLASSES):
    _OF[list(_c), _n] = 1


def features(text: str | None) -> list[float]:
    """Numbers about the whole text; all zero for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * N_FEATURES
    n = len(words)
    shares = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _OF / len(data)).tolist()
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 1.0
    tops = counts.most_common(3)
    lines = [x for x in data.split(b"\n") if x.strip()]
    length = sum(map(len, words)) / n
    again = 1 - len(set(lines)) / len(lines)
    ended = sum(x.rstrip()[-1:] in b".!?:" for x in lines) / len(lines)
    ends = sum(w[-1] in b"#$%&*!|" for w in words) / n
    upper = sum(map(bytes.isupper, words)) / n
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    runs = [math.log1p(n), min(length, 40) / 10, len(counts) / n, len(counts) / math.sqrt(n) / 10, pairs, tops[0][1] / n, sum(c for _, c in tops) / n]
    plain = [*shares, *runs, again, math.log1p(len(lines)), math.log1p(len(data) / len(lines)), ended, ends, upper, same]
    rooted = [math.sqrt(x) for x in (*shares, again, ends, upper, same)]
    return [*plain, *rooted]


N_FEATURES = 2 * len(CLASSES) + 18


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD)), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Model:
    """Rank documents by preference pairs, then cut at a quantile of the scores.

    The quantile is the one at which the classes of the sample are told apart best. Without both classes
    every score is near the only label, or near 1 without any.
    """
    flat = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0)
    if not len(y) or y.min() == y.max():
        flat.cut = 6.0 if len(y) and y[0] == 0 else -6.0
        return flat
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w, first, second = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, STEPS + 1):
        d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        grad = -d.T @ (1 / (1 + np.exp(d @ w))) / PAIRS + 1e-3 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= 0.05 * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    s = z @ w
    quantiles = np.linspace(0, 1, 1001)
    cuts = np.quantile(s, quantiles)
    hit = np.searchsorted(np.sort(s[bad]), cuts) / len(bad)  # of the bad, those under the cut
    lost = np.searchsorted(np.sort(s[good]), cuts) / len(good)
    gain = hit - lost
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    return Model(mean, scale, w, float(cuts[best[len(best) // 2]]), 1.0)


def _featured(docs: DataFrame, keep: list[str], kinds: list) -> DataFrame:
    schema = T.StructType([T.StructField(c, k) for c, k in zip(keep, kinds)] + [T.StructField("x", T.ArrayType(T.DoubleType()))])

    def kernel(columns: list) -> list:
        return [*columns[:-1], [features(t) for t in columns[-1]]]

    return map_rows(docs, kernel, [*keep, "text"], schema)


def model_of(docs: DataFrame, labels: DataFrame) -> Model:
    """Trained on rows whose crc32 of the id modulo 5 is not 0, ``2 * PER_CLASS`` of them at most."""
    sample = labelled_texts(docs, labels, "quality", 5, 0, PER_CLASS)
    rows = sorted((r.doc_id, r.label, r.x) for r in _featured(sample, ["doc_id", "label"], [sample.schema["doc_id"].dataType, T.IntegerType()]).collect())
    return fit(np.array([x for _, _, x in rows]).reshape(-1, N_FEATURES), np.array([y for _, y, _ in rows]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have all features zero and a score like any other. Labels with a null id or value
    are left out, those of one id count with the largest. A null id is not held out. Repeated rows come
    out as often as they went in; empty tables give no rows, and without labels of both classes the
    score is nearly constant. Columns other than ``doc_id`` and ``text`` play no part.
    """
    model = model_of(docs, labels)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])

    def kernel(columns: list) -> list:
        return [columns[0], model.score(np.array([features(t) for t in columns[1]]))]

    rows = map_rows(docs, kernel, ["doc_id", "text"], schema)
    return rows.select(
        "doc_id",
        F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
