"""Schemas, limits, options and errors of versioned key-value logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

DELETE, PUT = 0, 1
#: Sequence numbers have 56 bits; reading at the largest means reading the latest state.
MAX_SEQUENCE = (1 << 56) - 1
MAX_LONG = (1 << 63) - 1
BYTEWISE = "bytewise"

LOG = T.StructType([
    T.StructField("user_key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False),
    T.StructField("type", T.ByteType(), False), T.StructField("value", T.BinaryType()),
])

RUN_META = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("file_size", T.LongType()), T.StructField("num_entries", T.LongType()),
    T.StructField("smallest_key", T.BinaryType()), T.StructField("largest_key", T.BinaryType()), T.StructField("min_seq", T.LongType()), T.StructField("max_seq", T.LongType()),
])


class StoreError(Exception):
    """Base of all errors; ``status`` is the name a multi-key read reports."""

    status = "Error"


class NotFound(StoreError):
    status = "NotFound"


class Corruption(StoreError):
    status = "Corruption"


class NotSupported(StoreError):
    status = "NotSupported"


class InvalidArgument(StoreError):
    status = "InvalidArgument"


class IOFailure(StoreError):
    status = "IOError"


@dataclass(frozen=True)
class Comparator:
    """An order of keys: that of the bytes to which ``plain`` maps them, one to one; ``column`` does so over columns.

    A store keeps the name and refuses another one.
    """

    name: str
    plain: Callable[[bytes], bytes] = bytes
    column: Callable[[Column], Column] = lambda key: key


@dataclass(frozen=True)
class Options:
    """How a store is opened and shaped; sizes are in bytes."""

    create_if_missing: bool = False
    error_if_exists: bool = False
    write_buffer_size: int = 4 << 20
    #: Bits a key in the filter of a run; 0 for none.
    bits_per_key: int = 10
    l0_compaction_trigger: int = 4
    max_level_bytes: int = 8 << 20
    max_level_bytes_multiplier: int = 10
    max_num_levels: int = 7
    max_records_per_file: int = 5_000_000
    max_run_bytes: int = 1 << 30
    #: Bytes compaction may write for each byte written; at 0 only a backlog lets it run, under 0 there is no bound.
    max_write_amplification: float = 1.0
    backlog_factor: int = 4
    #: An order of keys, or the name of one that is bytewise.
    comparator: Comparator | str = BYTEWISE
    auto_compact: bool = False
    #: After how long without a sign of life a writer's lock is void.
    lease_seconds: float = 60.0

    @property
    def order(self) -> Comparator:
        return self.comparator if isinstance(self.comparator, Comparator) else Comparator(self.comparator)

    def validate(self) -> None:
        bad = {
            "write_buffer_size": self.write_buffer_size < 1,
            "l0_compaction_trigger": self.l0_compaction_trigger < 1,
            "max_level_bytes_multiplier": self.max_level_bytes_multiplier < 1,
            "max_num_levels": self.max_num_levels < 2,
            "bits_per_key": self.bits_per_key < 0,
            "max_run_bytes": self.max_run_bytes < 1,
            "lease_seconds": self.lease_seconds <= 0,
            "comparator": not self.order.name,
        }
        if any(bad.values()):
            raise InvalidArgument("invalid " + ", ".join(k for k, v in bad.items() if v))
