"""Bloom filters over keys: of one run in plain Python, of a table in parts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import fnv1a_column


@dataclass(frozen=True)
class Bloom:
    """Bits of a filter and the number of probes a key makes."""

    bits: bytes
    probes: int

    @staticmethod
    def of(keys: list[bytes], bits_per_key: int = 10) -> "Bloom":
        probes, size = probes_for(bits_per_key), size_for(len(keys), bits_per_key)
        bits = np.zeros(size, np.uint8)
        bits[_places(keys, probes, size).ravel()] = 1
        return Bloom(np.packbits(bits, bitorder="little").tobytes(), probes)

    def dump(self) -> bytes:
        """The bits and, in the last byte, the number of probes."""
        return self.bits + bytes([self.probes])

    @staticmethod
    def load(data: bytes) -> "Bloom":
        return Bloom(data[:-1], data[-1] if data else 0)

    def may_hold(self, keys: list[bytes]) -> np.ndarray:
        """False where a key is certainly absent. A filter with more than 30 probes is of a later format: always True."""
        if self.probes > 30:
            return np.ones(len(keys), bool)
        if not self.bits:
            return np.zeros(len(keys), bool)
        array = np.frombuffer(self.bits, np.uint8)
        places = _places(keys, self.probes, 8 * len(array))
        return (array[places >> 3] >> (places & 7).astype(np.uint8) & 1).all(axis=1)


class FilterPolicy(Protocol):
    """How the filter of a table is made and asked. ``name`` is stored with it; other names are not asked."""

    name: str

    def create(self, keys: list[bytes]) -> bytes: ...

    def may_hold(self, key: bytes, data: bytes) -> bool:
        """False only where ``key`` is certainly absent."""


@dataclass(frozen=True)
class BloomPolicy:
    bits_per_key: int = 10
    name: str = "bloom"

    def create(self, keys: list[bytes]) -> bytes:
        return Bloom.of(keys, self.bits_per_key).dump()

    def may_hold(self, key: bytes, data: bytes) -> bool:
        return bool(Bloom.load(data).may_hold([key])[0])


def probes_for(bits_per_key: int) -> int:
    return min(30, max(1, int(bits_per_key * 0.69)))


def size_for(count: int, bits_per_key: int) -> int:
    """Bits of a filter, whole bytes; hashes have 32 bits, so more would stay unused."""
    return min(1 << 32, max(64, -(-count * bits_per_key // 8) * 8))


def _places(keys: list[bytes], probes: int, size: int) -> np.ndarray:
    """Double hashing: the hash, then steps of it rotated, in 32 bits."""
    h = fnv1a_column(keys).astype(np.uint32)
    step = (h >> np.uint32(17)) | (h << np.uint32(15))
    return (h[:, None] + step[:, None] * np.arange(probes, dtype=np.uint32)).astype(np.int64) % size


def build(keys: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """``part, filter``: a filter of ``keys(user_key)`` in parts, each with the keys of one range of a hash.

    A part has about ``PART_KEYS`` keys, so neither the driver nor a task ever holds the bits of all keys,
    and there is no limit to their number.
    """
    parts = max(1, -(-keys.count() // PART_KEYS))

    def fill(rows: pa.Table) -> pa.Table:
        made = Bloom.of(rows.column("user_key").to_pylist(), bits_per_key)
        return pa.table({"part": rows.column("part")[:1], "filter": pa.array([made.dump()], pa.binary())})

    return keys.select(part_of(F.col("user_key"), parts).alias("part"), "user_key").groupBy("part").applyInArrow(fill, "part int, filter binary")


#: Keys of one part of a filter.
PART_KEYS = 1 << 20


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def probe(rows: DataFrame, filters: DataFrame, name: str = "may_hold") -> DataFrame:
    """``rows(user_key, ...)`` with a column that is false where the key is certainly absent, null for a null key.

    ``filters`` comes from ``build``; rows meet the part that their keys belong to.
    """
    parts = (filters.agg(F.max("part").alias("last")).first().last or 0) + 1 if not filters.isEmpty() else 1

    @F.arrow_udf("boolean")
    def holds(keys: pa.Array, filters: pa.Array) -> pa.Array:
        out = np.zeros(len(keys), bool)
        listed, encoded = keys.to_pylist(), filters.dictionary_encode()
        which = encoded.indices.to_pylist()
        for n, data in enumerate(encoded.dictionary.to_pylist()):
            places = [i for i, w in enumerate(which) if w == n and listed[i] is not None]
            out[places] = Bloom.load(data).may_hold([listed[i] for i in places])
        return pa.array(out, mask=np.array([k is None for k in listed], bool))

    met = rows.withColumn("_part", part_of(F.col("user_key"), parts)).join(filters.select(F.col("part").alias("_part"), F.col("filter").alias("_filter")), "_part", "left")
    return met.withColumn(name, F.when(F.col("user_key").isNotNull(), F.coalesce(holds("user_key", "_filter"), F.lit(False)))).drop("_part", "_filter")
