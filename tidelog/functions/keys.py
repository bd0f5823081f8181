"""Key functions: plain Python on bytes, the same over columns, and native expressions where Spark has them."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import MAX_SEQUENCE, PUT, Comparator

# The reversed Castagnoli polynomial; offset and prime of 32-bit FNV-1a.
CASTAGNOLI = 0x82F63B78
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all that start with ``prefix``; None if there is none."""
    trimmed = prefix.rstrip(b"\xff")
    return trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None


def short_successor(key: bytes) -> bytes:
    """A short key at or above ``key``: its first byte that can grow, grown; ``key`` itself if none can."""
    for i, b in enumerate(key):
        if b < 255:
            return key[:i] + bytes([b + 1])
    return key


def short_separator(start: bytes, limit: bytes) -> bytes:
    """A short key in ``[start, limit)`` for ``start < limit``, as short as one grown byte behind the common part allows."""
    same = 0
    while same < min(len(start), len(limit)) and start[same] == limit[same]:
        same += 1
    if same == min(len(start), len(limit)):
        return start
    if start[same] < 255 and start[same] + 1 < limit[same]:
        return start[:same] + bytes([start[same] + 1])
    return start


def internal_separator(start: bytes, limit: bytes) -> tuple[bytes, int, int] | None:
    """A shortened user key with the largest sequence, which sorts before its other versions; None if it did not shorten."""
    short = short_separator(start, limit)
    return (short, MAX_SEQUENCE, PUT) if len(short) < len(start) and start < short else None


def internal_successor(key: bytes) -> tuple[bytes, int, int] | None:
    short = short_successor(key)
    return (short, MAX_SEQUENCE, PUT) if len(short) < len(key) and key < short else None


def varint(value: int, bits: int = 64) -> bytes:
    if not 0 <= value < 1 << bits:
        raise ValueError(f"{value} does not fit {bits} bits")
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def read_varint(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """The value at ``at`` and where the next begins; ValueError if it is cut off or too long."""
    value = 0
    for n in range(-(-bits // 7)):
        if at + n >= len(data):
            raise ValueError("varint is cut off")
        value |= (data[at + n] & 127) << (7 * n)
        if data[at + n] < 128:
            return value & ((1 << bits) - 1), at + n + 1
    raise ValueError("varint is too long")


def fixed32(value: int) -> bytes:
    return struct.pack("<I", value)


def fixed64(value: int) -> bytes:
    return struct.pack("<Q", value)


def length_prefixed(data: bytes) -> bytes:
    return varint(len(data), 32) + data


def read_length_prefixed(data: bytes, at: int = 0) -> tuple[bytes, int]:
    size, at = read_varint(data, at, 32)
    if at + size > len(data):
        raise ValueError("slice is cut off")
    return data[at : at + size], at + size


def _remainders() -> np.ndarray:
    """What each byte adds to a running Castagnoli checksum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1)
    return table


_REMAINDERS = _remainders()
_TABLE = _REMAINDERS.tolist()


#: Bytes from which a checksum is taken over pieces side by side.
_LONG = 1024


def _zeros(crc: np.ndarray, count: int) -> np.ndarray:
    """The images of checksum registers under ``count`` zero bytes, by squaring the map of one."""
    step = np.array([_step(1 << i, 0) for i in range(32)], np.uint32)
    while count:
        if count & 1:
            crc = _mapped(step, crc)
        count >>= 1
        if count:
            step = _mapped(step, step)
    return crc


def _step(crc: int, byte: int) -> int:
    return int(_REMAINDERS[(crc ^ byte) & 255]) ^ crc >> 8


def _mapped(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by the images of the 32 bits, on each of ``crc``."""
    bits = (crc[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits, step, np.uint32(0)), axis=1)


@lru_cache(64)
def _skip(count: int) -> list[list[int]]:
    """What each byte of a register becomes after ``count`` zero bytes, a table for each of its four bytes."""
    values = np.arange(256, dtype=np.uint32)
    return [_zeros(values << np.uint32(8 * k), count).tolist() for k in range(4)]


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C of ``data``; ``crc`` is that of what comes before.

    Long data is cut into pieces of one length whose registers run side by side and are then joined.
    """
    crc ^= 0xFFFFFFFF
    if len(data) >= _LONG:
        width = 1 << (len(data).bit_length() // 2)
        whole = len(data) // width * width
        matrix = np.frombuffer(data, np.uint8, whole).reshape(-1, width)
        lanes = np.zeros(len(matrix), np.uint32)
        for i in range(width):
            lanes = _REMAINDERS[(lanes ^ matrix[:, i]) & 255] ^ (lanes >> np.uint32(8))
        a, b, c, d = _skip(width)
        for lane in lanes.tolist():
            crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24] ^ lane
        data = data[whole:]
    table = _TABLE
    for x in data:
        crc = table[(crc ^ x) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def _alike(data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The values in groups of about one length: places, bytes in one matrix with zeros behind, lengths.

    A matrix has at most twice the bytes of its values, so one long value does not widen all others.
    """
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    classes = np.array([int(n).bit_length() for n in lengths], np.int64)
    for kind in np.unique(classes):
        places = np.flatnonzero(classes == kind)
        width = int(lengths[places].max())
        joined = b"".join(data[i].ljust(width, b"\0") for i in places)
        yield places, np.frombuffer(joined, np.uint8).reshape(len(places), width), lengths[places]


def crc32c_column(values: list[bytes]) -> np.ndarray:
    """CRC-32C of many values, a byte of all short ones of a length class at a time."""
    out = np.zeros(len(values), np.int64)
    for places, matrix, lengths in _alike(values):
        if matrix.shape[1] >= _LONG:
            out[places] = [crc32c(values[i]) for i in places]
            continue
        crc = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
        for i in range(matrix.shape[1]):
            step = _REMAINDERS[(crc ^ matrix[:, i]) & 255] ^ (crc >> np.uint32(8))
            crc = np.where(i < lengths, step, crc)
        out[places] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def fnv1a_column(values: list[bytes]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for places, matrix, lengths in _alike(values):
        h = np.full(len(lengths), FNV_OFFSET, np.uint32)
        for i in range(matrix.shape[1]):
            h = np.where(i < lengths, (h ^ matrix[:, i]) * np.uint32(FNV_PRIME), h)
        out[places] = h
    return out


def _on_bytes(kernel: Callable[[list[bytes]], np.ndarray], values: pa.Array) -> pa.Array:
    """``kernel`` on the values that are there; null for null."""
    listed = values.to_pylist()
    there = [v is not None for v in listed]
    found = iter(kernel([v for v in listed if v is not None]).tolist())
    return pa.array([next(found) if t else None for t in there], pa.int64())


@F.arrow_udf(T.LongType())
def crc32c_udf(values: pa.Array) -> pa.Array:
    """CRC-32C of a binary column; null for null."""
    return _on_bytes(crc32c_column, values)


@F.arrow_udf(T.LongType())
def fnv1a_udf(values: pa.Array) -> pa.Array:
    return _on_bytes(fnv1a_column, values)


# the same over columns, native; null for null


def _hex_byte(value: Column) -> Column:
    return F.lpad(F.hex(value.bitwiseAND(F.lit(255))), 2, "0")


def _byte_at(digits: Column, at: int) -> Column:
    """Byte ``at`` of a string of hex digits as a number."""
    return F.conv(F.substring(digits, 2 * at + 1, 2), 16, 10).cast("long")


def varint_column(value: Column) -> Column:
    """The varint of an integer column as binary; negative numbers count as unsigned ones of 64 bits."""
    value = value.cast("long")
    parts = []
    for i in range(10):
        rest = F.shiftrightunsigned(value, 7 * i)
        more = F.shiftrightunsigned(value, 7 * i + 7) if i < 9 else F.lit(0)
        byte = rest.bitwiseAND(F.lit(127)).bitwiseOR(F.when(more != 0, 128).otherwise(0))
        parts.append(_hex_byte(byte) if i == 0 else F.when(rest != 0, _hex_byte(byte)).otherwise(""))
    return F.unhex(F.concat(*parts))


def _varint_digits(data: Column) -> Column:
    """The hex digits of the varint ``data`` starts with, none if it is cut off or too long."""
    return F.regexp_extract(F.hex(F.substring(data, 1, 10)), r"^((?:[89A-F].){0,9}[0-7].)", 1)


def _varint_value(digits: Column) -> Column:
    value = F.lit(0).cast("long")
    for i in range(10):
        part = F.shiftleft(_byte_at(digits, i).bitwiseAND(F.lit(127)), 7 * i)
        value = value.bitwiseOR(F.when(F.length(digits) > 2 * i, part).otherwise(F.lit(0).cast("long")))
    return value


def read_varint_column(data: Column) -> Column:
    """The number of the varint at the start of a binary column; null if it is cut off or too long."""
    digits = _varint_digits(data)
    return F.when(digits != "", _varint_value(digits))


def length_prefixed_column(data: Column) -> Column:
    data = data.cast("binary")
    return F.concat(varint_column(F.octet_length(data)), data)


def read_length_prefixed_column(data: Column) -> Column:
    """The slice at the start of a binary column; null if it is cut off."""
    digits = _varint_digits(data)
    head, size = F.length(digits) / 2, _varint_value(digits)
    there = (digits != "") & (F.octet_length(data) >= head + size)
    return F.when(there, F.substring(data, (head + 1).cast("int"), size.cast("int")))


def fixed_column(value: Column, bits: int = 64) -> Column:
    """The little-endian bytes of an integer column as binary."""
    value = value.cast("long")
    return F.unhex(F.concat(*(_hex_byte(F.shiftrightunsigned(value, 8 * i)) for i in range(bits // 8))))


def read_fixed_column(data: Column, bits: int = 64) -> Column:
    """The number at the start of a binary column, of 64 bits signed; null if it is cut off."""
    digits = F.hex(F.substring(data, 1, bits // 8))
    value = F.lit(0).cast("long")
    for i in range(bits // 8):
        value = value.bitwiseOR(F.shiftleft(_byte_at(digits, i), 8 * i))
    return F.when(F.octet_length(data) >= bits // 8, value)


def _grown(key: Column, at: Column) -> Column:
    """``key`` up to the byte ``at``, counted from 1, which is one more."""
    byte = F.conv(F.hex(F.substring(key, at, 1)), 16, 10).cast("int")
    return F.concat(F.substring(key, F.lit(1), at - 1), F.unhex(_hex_byte(byte + 1)))


def short_successor_column(key: Column) -> Column:
    """``short_successor`` of a binary column."""
    full = F.length(F.regexp_extract(F.hex(key), "^((?:FF)*)", 1)) / 2
    at = (full + 1).cast("int")
    return F.when(at > F.octet_length(key), key).otherwise(_grown(key, at))


def short_separator_column(start: Column, limit: Column) -> Column:
    """``short_separator`` of two binary columns."""
    end = F.least(F.octet_length(start), F.octet_length(limit))
    same_byte = lambda i: F.substring(start, i, 1) == F.substring(limit, i, 1)
    places = F.when(end > 0, F.sequence(F.lit(1), end)).otherwise(F.array().cast("array<int>"))
    same = F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i - 1) & same_byte(i), i).otherwise(n))
    at = same + 1
    byte = lambda key: F.conv(F.hex(F.substring(key, at, 1)), 16, 10).cast("int")
    fits = (at <= end) & (byte(start) < 255) & (byte(start) + 1 < byte(limit))
    return F.when(start.isNull() | limit.isNull(), F.lit(None).cast("binary")).when(fits, _grown(start, at)).otherwise(start)


def _internal(short: Column, key: Column) -> Column:
    made = F.struct(short.alias("user_key"), F.lit(MAX_SEQUENCE).alias("seq"), F.lit(PUT).cast("byte").alias("type"))
    return F.when((F.octet_length(short) < F.octet_length(key)) & (key < short), made)


def internal_separator_column(start: Column, limit: Column) -> Column:
    """``internal_separator`` of two binary columns: a struct of ``user_key, seq, type``, null where it did not shorten."""
    return _internal(short_separator_column(start, limit), start)


def internal_successor_column(key: Column) -> Column:
    return _internal(short_successor_column(key), key)


def pack(seq: Column, kind: Column) -> Column:
    """Sequence and type in one number: the low byte is the type."""
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(kind.cast("long"))


def unpack(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 8), packed.bitwiseAND(F.lit(255)).cast("byte")


def internal_key(key: Column, seq: Column, kind: Column) -> Column:
    return F.struct(key.alias("user_key"), seq.alias("seq"), kind.alias("type"))


def debug_string(key: Column, seq: Column, kind: Column) -> Column:
    return F.format_string("'%s' @ %d : %d", key, seq, kind)


#: Shorter keys first, keys of one length bytewise: the order of numbers written without zeros in front.
SHORTLEX = Comparator(
    "shortlex", lambda key: struct.pack(">I", len(key)) + key, lambda key: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(key)), 8, "0")), key.cast("binary"))
)


def varint_length(value: Column) -> Column:
    """Bytes of the varint of a non-negative number: one for each seven bits begun."""
    return F.ceil(F.length(F.bin(value)) / 7).cast("long")


def fixed64_hex(value: Column) -> Column:
    """The eight little-endian bytes of a number, in hex."""
    big = F.lpad(F.hex(value), 16, "0")
    return F.concat(*(F.substring(big, 15 - 2 * i, 2) for i in range(8)))
