"""Media columns: texts stored as WAV samples, and spectral-peak fingerprints of what is stored.

A payload is written as 8-bit mono samples by the ``wave`` module into a binary column, that column is
stored as Parquet and read again, and the features come from the samples read. A short-time Fourier
transform gives the strongest bin of each band of each frame; those that stand out in time are peaks,
and each peak is paired with those that follow it. A pair is a code of both bins and their distance,
kept with the frame of its first peak: two arrays of equal length, times and codes.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import map_rows, shared_folder, table

UNIT, RATE = 64, 8000
FRAME, HOP = 512, 256
#: Edges of the frequency bands, in bins.
BANDS = (2, 16, 48, 112, 257)
#: Frames on either side that a peak must not fall below, peaks paired with each, frames between them at most.
NEAR, FAN, REACH = 2, 2, 63
#: Frames transformed at once; bounds the memory a very long text needs.
BLOCK = 4096

_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def payload(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8, zeros appended up to a positive multiple of ``UNIT``; and its bytes without those."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT if data else UNIT), len(data)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def band_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The strongest bin and its magnitude, frames x bands."""
    signal = np.frombuffer(samples, np.uint8)
    frames = max(1, 1 + -(-(len(signal) - FRAME) // HOP))
    bins, powers = [], []
    for first in range(0, frames, BLOCK):
        count = min(BLOCK, frames - first)
        part = np.full((count - 1) * HOP + FRAME, 128, np.float32)
        piece = signal[first * HOP : first * HOP + len(part)]
        part[: len(piece)] = piece
        view = np.lib.stride_tricks.sliding_window_view(part - 128, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(view * _HANN, axis=1))
        best = [a + power[:, a:b].argmax(axis=1) for a, b in zip(BANDS, BANDS[1:])]
        bins.append(np.stack(best, axis=1))
        powers.append(np.take_along_axis(power, bins[-1], axis=1))
    return np.concatenate(bins), np.concatenate(powers)


def pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the peak pairs: ``code = bin << 15 | bin of the other << 6 | frames between``."""
    bins, powers = band_peaks(samples)
    stands = powers > 0
    for step in range(1, NEAR + 1):
        stands[step:] &= powers[step:] > powers[:-step]
        stands[:-step] &= powers[:-step] >= powers[step:]
    time, band = np.nonzero(stands)  # in the order of time, then of band
    tone = bins[time, band]
    times, codes = [], []
    for step in range(1, FAN + 1):
        gap = time[step:] - time[:-step]
        kept = np.flatnonzero(gap <= REACH)
        times.append(time[kept])
        codes.append(tone[kept] << 15 | tone[kept + step] << 6 | gap[kept])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("codes", T.ArrayType(T.IntegerType())),
])


def as_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: a WAV file in each row. Null and empty texts are ``UNIT`` zeros."""

    def kernel(columns: list) -> list:
        made = [payload(t) for t in columns[1]]
        return [columns[0], [n for _, n in made], [to_wav(p) for p, _ in made]]

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, ["doc_id", "text"], MEDIA)


def features(media: DataFrame) -> DataFrame:
    """What ``media(doc_id, n_bytes, media)`` holds: sizes, digests and the fingerprint arrays of its samples."""

    def kernel(columns: list) -> list:
        out = []
        for doc_id, n, stored in zip(*columns):
            samples = from_wav(stored)
            times, codes = pairs(samples)
            out.append((doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), times, codes))
        return list(zip(*out))

    return map_rows(media, kernel, ["doc_id", "n_bytes", "media"], FEATURES)


def stored(media: DataFrame) -> DataFrame:
    """``media`` written to shared storage and read again."""
    path = shared_folder(media.sparkSession, "media")
    media.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(media.schema).parquet(path)


def described(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` as media, read it back and return its features, one row for each row.

    Equal texts have equal values. An empty table gives no rows; other columns are ignored.
    """
    return features(stored(as_media(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = described(table(spark, sf_dir, "documents"))
    coded = F.zip_with("times", "codes", lambda t, c: F.concat(t.cast("string"), F.lit(":"), F.lower(F.hex(c))))
    return found.select(*(c for c in found.columns if c not in ("times", "codes")), F.array_join(coded, " ").alias("feature"))
