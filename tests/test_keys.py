from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import bloom, keys


def test_crc32c_vector():
    assert keys.crc32c(b"123456789") == 0xE3069283
    assert keys.crc32c(b"6789", keys.crc32c(b"12345")) == 0xE3069283
    assert keys.crc32c_column([b"123456789", b"", b"12345"]).tolist() == [0xE3069283, 0, keys.crc32c(b"12345")]


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c_of_all_lengths():
    rng = random.Random(1)
    data = [rng.randbytes(n) for n in (*range(20), 255, 256, 1023, 1024, 1025, 5000, 40_000)]
    assert keys.crc32c_column(data).tolist() == [plain_crc32c(d) for d in data]
    assert keys.crc32c(data[-1][700:], keys.crc32c(data[-1][:700])) == keys.crc32c(data[-1])


def test_one_long_value_does_not_widen_the_others():
    data = [b"short"] * 200 + [bytes(2_000_000)]
    assert max(m.nbytes for _, m, _ in keys._alike(data)) <= 2 * 2_000_000
    assert keys.crc32c_column(data)[0] == keys.crc32c(b"short") and keys.fnv1a_column(data)[:1] == keys.fnv1a_column([b"short"])


def fnv(data):
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_fnv1a_vector():
    assert keys.fnv1a_column([b"", b"a", b"foobar"]).tolist() == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_columns_against_plain_python_with_nulls(spark):
    rng = random.Random(2)
    numbers = [None, 0, 1, 127, 128, 16383, 16384, 2**31, 2**56 - 1, 2**63 - 1, -1, -(2**63)]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select(
        "n", keys.varint_column(F.col("n")).alias("v"), keys.read_varint_column(keys.varint_column(F.col("n"))).alias("back"),
        keys.fixed_column(F.col("n")).alias("f"), keys.read_fixed_column(keys.fixed_column(F.col("n"))).alias("fback"), keys.fixed_column(F.col("n"), 32).alias("f32"),
    ).collect()
    for r in got:
        if r.n is None:
            assert r.v is r.back is r.f is r.fback is r.f32 is None
        else:
            assert (bytes(r.v), r.back, bytes(r.f), r.fback) == (keys.varint(r.n % 2**64), r.n, keys.fixed64(r.n % 2**64), r.n)
            assert bytes(r.f32) == keys.fixed32(r.n % 2**32)
    pairs = [(None, b"a"), (b"a", None), (b"", b""), (b"", b"a"), (b"a", b"c"), (b"a", b"b"), (b"ab", b"abc"), (b"\xff\xff", b"\xff\xffa"), (b"a\xff", b"c"), (b"\xff", b"\xff\xff")]
    pairs += [tuple(bytes(rng.choices(b"ab\xfe\xff", k=rng.randrange(5))) for _ in range(2)) for _ in range(100)]
    rows = spark.createDataFrame([tuple(None if x is None else bytearray(x) for x in p) for p in pairs], "a binary, b binary")
    a, b = F.col("a"), F.col("b")
    out = rows.select(
        "a", "b", keys.short_separator_column(a, b).alias("sep"), keys.short_successor_column(a).alias("suc"), keys.internal_separator_column(a, b).alias("isep"),
        keys.internal_successor_column(a).alias("isuc"), keys.crc32c_udf(a).alias("crc"), keys.fnv1a_udf(a).alias("fnv"), keys.length_prefixed_column(a).alias("framed"),
        keys.read_length_prefixed_column(keys.length_prefixed_column(a)).alias("back"), keys.read_length_prefixed_column(a).alias("wild"), keys.read_varint_column(a).alias("number"),
    ).collect()
    internal = lambda x: None if x is None else (bytes(x.user_key), x.seq, x.type)

    def attempt(read, data):
        try:
            return read(data)[0]
        except ValueError:
            return None

    for r in out:
        x, y = (None if v is None else bytes(v) for v in (r.a, r.b))
        if x is None:
            assert r.sep is r.suc is r.isep is r.isuc is r.crc is r.fnv is r.framed is r.back is r.wild is r.number is None
            continue
        assert (bytes(r.suc), internal(r.isuc)) == (keys.short_successor(x), keys.internal_successor(x))
        assert (r.crc, r.fnv, bytes(r.framed), bytes(r.back)) == (plain_crc32c(x), fnv(x), keys.length_prefixed(x), x)
        assert (None if r.wild is None else bytes(r.wild), r.number) == (attempt(keys.read_length_prefixed, x), attempt(keys.read_varint, x))
        if y is None:
            assert r.sep is None and r.isep is None
        else:
            assert (bytes(r.sep), internal(r.isep)) == (keys.short_separator(x, y), keys.internal_separator(x, y))


@given(st.integers(0, 2**64 - 1), st.binary(max_size=5))
def test_varint_round_trip(value, rest):
    assert keys.read_varint(keys.varint(value) + rest) == (value, len(keys.varint(value)))


@pytest.mark.parametrize("data", [b"", b"\x80", b"\xff" * 5 + b"\x01"])
def test_bad_varints(data):
    with pytest.raises(ValueError):
        keys.read_varint(data, bits=32)


@given(st.binary(max_size=200), st.binary(max_size=5))
def test_length_prefix_round_trip(data, rest):
    framed = keys.length_prefixed(data)
    assert keys.read_length_prefixed(framed + rest) == (data, len(framed))


def test_fixed_encodings():
    assert keys.fixed32(0x04030201) == b"\x01\x02\x03\x04" and keys.fixed64(1) == b"\x01" + bytes(7)


@given(st.binary(max_size=6), st.binary(max_size=6))
def test_separator_and_successor(a, b):
    start, limit = sorted((a, b))
    if start < limit:
        short = keys.short_separator(start, limit)
        assert start <= short < limit and len(short) <= len(start)
    assert keys.short_successor(a) >= a and len(keys.short_successor(a)) <= len(a)


@given(st.binary(max_size=4), st.binary(max_size=6))
def test_prefix_end(prefix, key):
    end = keys.prefix_end(prefix)
    assert key.startswith(prefix) == (prefix <= key and (end is None or key < end))


def test_native_expressions(spark):
    row = spark.range(1).select(
        keys.pack(F.lit(7), F.lit(1)).alias("packed"), keys.debug_string(F.lit("k"), F.lit(7), F.lit(1)).alias("text"),
        *(keys.varint_length(F.lit(v)).alias(f"n{v}") for v in (0, 127, 128, 16384)), keys.fixed64_hex(F.lit(258)).alias("fixed"),
    ).first()
    assert (row.packed, row.text, row.n0, row.n127, row.n128, row.n16384, row.fixed) == (1793, "'k' @ 7 : 1", 1, 1, 2, 3, "0201000000000000")


@pytest.mark.parametrize("part_keys", [1 << 20, 300])
def test_bloom_filter(spark, monkeypatch, part_keys):
    monkeypatch.setattr(bloom, "PART_KEYS", part_keys)
    there = [f"key{i}".encode() for i in range(2000)]
    frame = lambda keys_: spark.createDataFrame([(None if k is None else bytearray(k),) for k in keys_], "user_key binary")
    made = bloom.build(frame(there))
    assert made.count() == (1 if part_keys > 2000 else 7)
    assert bloom.probe(frame(there), made).where("may_hold").count() == 2000
    absent = bloom.probe(frame([*(f"zzz{i}".encode() for i in range(2000)), None]), made)
    assert absent.where("may_hold").count() < 100 and absent.where("may_hold is null").count() == 1
    assert bloom.probe(frame([b"a"]), bloom.build(frame([]))).where("may_hold").count() == 0


def test_bloom_bytes():
    made = bloom.Bloom.of([f"key{i}".encode() for i in range(2000)])
    assert bloom.Bloom.load(made.dump()) == made and made.dump()[-1] == 6 and len(made.bits) == 2500
    assert bloom.probes_for(10) == 6 and bloom.probes_for(1) == 1 and bloom.probes_for(1000) == 30
    assert not bloom.Bloom(b"", 6).may_hold([b"a"]).any() and bloom.Bloom(b"", 31).may_hold([b"a"]).all()
    assert bloom.size_for(10**9, 10) == 2**32 and bloom.size_for(0, 10) == 64


def test_random_slices_compare_as_bytes(spark):
    rng = random.Random(0)
    values = [bytes(rng.choices(b"\x00a\x7f\xff", k=rng.randrange(4))) for _ in range(60)]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "k binary")
    assert [bytes(r.k) for r in df.orderBy("k").collect()] == sorted(values)
