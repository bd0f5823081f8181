from __future__ import annotations

import random

import pytest

from tests.conftest import pairs
from tidelog.functions.keys import length_prefixed, varint
from tidelog.operators import mvcc
from tidelog.schema import Corruption
from tidelog.sources import interchange as x


def test_log_framing():
    records = [b"", b"a" * 5, b"b" * 1000, b"c" * 65536, b"d" * (x.BLOCK - 7 - 3), b"end"]
    data = x.framed_log(records)
    assert list(x.log_payloads(data)) == records
    assert list(x.log_payloads(data[:-1])) == records[:-1]  # a torn end
    assert list(x.log_payloads(data + b"\x01\x02")) == records
    for at in (0, 20, x.BLOCK + 50):
        with pytest.raises(Corruption):
            list(x.log_payloads(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))


def test_batches():
    rows = [(b"a", 100, 1, b"x"), (b"", 101, 1, b""), (b"c", 102, 0, None)]
    data = x.encoded_batch(rows)
    assert x.batch_rows(data) == rows and x.batch_rows(x.encoded_batch([])) == []
    for bad in (data[:8], data[:-1], data + b"\x07", data + b"\x00\x01z"):
        with pytest.raises(Corruption):
            x.batch_rows(bad)


def test_tables_round_trip_and_notice_damage():
    rng = random.Random(0)
    rows = [(rng.randbytes(rng.randrange(6)), s, rng.randrange(2), None) for s in range(1, 600)]
    rows = [(k, s, t, rng.randbytes(40) if t else None) for k, s, t, _ in rows]
    data = x.encoded_table(rows, 512)
    assert list(x.table_rows(data)) == sorted(rows, key=lambda r: (r[0], -r[1]))
    assert list(x.table_rows(x.encoded_table([]))) == []
    for bad in (data[:-1], data[:10], b"", data[:100] + bytes([data[100] ^ 1]) + data[101:]):
        with pytest.raises(Corruption):
            list(x.table_rows(bad))


def test_damage_is_reported_and_passed_over():
    records = [b"a" * 5, b"b" * 40_000, b"c" * 10, b"d" * 40_000, b"end"]
    data = x.framed_log(records)
    lost = []
    broken = data[:20] + bytes([data[20] ^ 1]) + data[21:]  # in the second record, in the first block
    assert list(x.log_payloads(broken, report=lambda n, why: lost.append((n, why)))) == [records[0], *records[2:]]
    assert [n for n, _ in lost] == [x.BLOCK - 12, 40_000 - (x.BLOCK - 12 - x.HEADER)]
    assert list(x.log_payloads(data, report=lambda *_: lost.append(1))) == records and 1 not in lost


def test_points_of_a_table():
    rng = random.Random(3)
    keys = [b"key%04d" % rng.randrange(800) for _ in range(1500)]
    rows = [(k, s, int(rng.random() < 0.8), None) for s, k in enumerate(keys, 1)]
    rows = [(k, s, t, b"v%d" % s if t else None) for k, s, t, _ in rows]
    for policy in (x.BloomPolicy(), x.BloomPolicy(1), None):
        data = x.encoded_table(rows, 700, policy)
        assert list(x.table_rows(data)) == sorted(rows, key=lambda r: (r[0], -r[1]))
        for _ in range(60):
            key, seq = b"key%04d" % rng.randrange(900), rng.randrange(1600)
            want = max((r for r in rows if r[0] == key and r[1] <= seq), key=lambda r: r[1], default=None)
            assert x.table_get(data, key, seq, policy) == want
        assert x.table_get(data, b"", 9, policy) is None and x.table_get(data, b"zzz", 9, policy) is None
        assert (x.table_filter(data) is None) == (policy is None)
        assert x.table_get(data, keys[0], 2000, x.BloomPolicy(10, "another")) is not None


def test_a_policy_of_ones_own():
    class First:
        name = "first letters"

        def create(self, keys):
            return bytes(sorted({k[0] for k in keys}))

        def may_hold(self, key, data):
            return key[0] in data

    data = x.encoded_table([(b"a1", 1, 1, b"x"), (b"c1", 2, 1, b"y")], policy=First())
    assert x.table_filter(data, "first letters") == b"ac" and x.table_get(data, b"c1", 5, First()) == (b"c1", 2, 1, b"y")
    assert x.table_get(data, b"b", 5, First()) is None


def test_edits_round_trip():
    run = {"run_id": 300, "level": 2, "file_size": 1 << 40, "smallest_key": b"a", "largest_key": b"z\xff"}
    edit = x.encoded_edit("bytewise", 7, 99, [run | {"min_seq": 1, "max_seq": 99}, run | {"run_id": 5, "level": 0}], [4, 1000])
    assert x.edit_fields(edit) == {"comparator": "bytewise", "log_number": 7, "last_sequence": 99, "new_files": [run, run | {"run_id": 5, "level": 0}], "deleted_files": [4, 1000]}
    assert x.edit_fields(x.encoded_edit()) == x.edit_fields(b"")
    log = x.framed_log([edit, x.encoded_edit(deleted_files=[5])])
    assert set(x.live_runs(log)) == {300} and x.live_tables(log)[0] == {300}


def test_prefix_compressed_entries():
    entries = b"\0\x03\x01abcX" + b"\x02\x02\x01deY"
    assert list(x._entries(entries + b"\0\0\0\0\1\0\0\0")) == [(b"abc", b"X"), (b"abde", b"Y")]


def _edit(comparator=None, log=None, last=None, new=(), gone=()):
    out = b"" if comparator is None else b"\1" + length_prefixed(comparator)
    out += b"" if log is None else b"\2" + varint(log)
    out += b"" if last is None else b"\5" + varint(last)
    for number, level in new:
        out += b"\3" + varint(number) + varint(10) + length_prefixed(b"a" + bytes(8)) + length_prefixed(b"z" + bytes(8)) + b"\6" + varint(level)
    return out + b"".join(b"\4" + varint(n) for n in gone)


def test_manifest_edits():
    manifest = x.framed_log([_edit(b"bytewise", 3, 0), _edit(log=5, last=7, new=[(4, 0), (6, 1)]), _edit(gone=[4], new=[(8, 2)])])
    assert x.live_tables(manifest) == ({6, 8}, 5, 7)
    assert x.edit_fields(_edit(new=[(4, 3)]))["new_files"][0]["level"] == 3
    for bad in (b"\x09", b"\x06\x01", b"\x03\x01"):
        with pytest.raises(Corruption):
            x.edit_fields(bad)


def test_a_store_folder_becomes_a_log(spark, tmp_path):
    folder = tmp_path / "old"
    folder.mkdir()
    (folder / "000004.ldb").write_bytes(x.encoded_table([(b"stale", 1, 1, b"gone")]))
    (folder / "000006.ldb").write_bytes(x.encoded_table([(b"a", 2, 1, b"old"), (b"b", 3, 1, b"x")]))
    (folder / "000005.log").write_bytes(x.framed_log([x.encoded_batch([(b"a", 8, 1, b"new"), (b"b", 9, 0, None)])]))
    (folder / "000002.log").write_bytes(x.framed_log([x.encoded_batch([(b"z", 1, 1, b"flushed")])]))
    (folder / "MANIFEST").write_bytes(x.framed_log([_edit(b"bytewise", 5, 7, [(4, 0), (6, 0)]), _edit(gone=[4])]))
    log = x.read_store(spark, f"file://{folder}")
    assert pairs(mvcc.visible(log)) == [("a", "new")]
    assert sorted(pairs(mvcc.visible(log, 7))) == [("a", "old"), ("b", "x")]
    (tmp_path / "none").mkdir()
    assert x.read_store(spark, f"file://{tmp_path}/none").count() == 0


def _runs(spark):
    rng = random.Random(5)
    rows = [(n // 50, rng.randbytes(rng.randrange(8)), n + 1, kind := int(rng.random() < 0.8), rng.randbytes(900) if kind else None) for n in range(200)]
    return rows, spark.createDataFrame(rows, "run_id long, user_key binary, seq long, type byte, value binary")


def _through_driver(spark, write):
    """What ``write`` gives, and the calls by which it brought rows to the driver or wrote files from there."""
    from tidelog.sources.files import Files

    calls = []
    with pytest.MonkeyPatch.context() as patch:
        for cls, name in ((type(spark.range(0)), "toLocalIterator"), (type(spark.range(0)), "collect"), (Files, "create")):
            patch.setattr(cls, name, lambda *a, f=getattr(cls, name), **k: calls.append(f.__name__) or f(*a, **k))
        return write(), calls


def _read(rows):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows.orderBy("seq").collect()]


def test_tables_are_written_where_their_rows_lie(spark, tmp_path):
    rows, log = _runs(spark)
    names, calls = _through_driver(spark, lambda: x.write_tables(log, f"file://{tmp_path}/tables"))
    assert not calls and names == [f"file://{tmp_path}/tables/{n:06d}.ldb" for n in range(4)]
    for n in range(4):
        assert (tmp_path / f"tables/{n:06d}.ldb").read_bytes() == x.encoded_table([r[1:] for r in rows if r[0] == n])
    assert sorted(p.name for p in (tmp_path / "tables").iterdir() if p.name[0] != ".") == [f"{n:06d}.ldb" for n in range(4)]
    assert _read(x.read_tables(spark, f"file://{tmp_path}/tables")) == _read(x.read_tables(spark, *names)) == [r[1:] for r in rows]
    assert x.write_tables(log.where("false"), f"file://{tmp_path}/none") == [] and x.read_tables(spark, f"file://{tmp_path}/none").count() == 0


def test_files_that_are_there_stay(spark, tmp_path):
    from tidelog.schema import IOFailure

    _, log = _runs(spark)
    x.write_tables(log.where("run_id = 1"), f"file://{tmp_path}/tables")
    before = (tmp_path / "tables/000001.ldb").read_bytes()
    with pytest.raises(IOFailure):
        x.write_tables(log.where("seq > 60"), f"file://{tmp_path}/tables")
    assert (tmp_path / "tables/000001.ldb").read_bytes() == before and not (tmp_path / "tables/000002.ldb").exists()
    assert x.write_tables(log.where("run_id > 1"), f"file://{tmp_path}/tables") == [f"file://{tmp_path}/tables/{n:06d}.ldb" for n in (2, 3)]


def test_logs_are_written_where_their_rows_lie(spark, tmp_path):
    rows, log = _runs(spark)
    names, calls = _through_driver(spark, lambda: x.write_logs(log, f"file://{tmp_path}/logs"))
    assert not calls and names == [f"file://{tmp_path}/logs/{n:06d}.log" for n in range(4)]
    for n in range(4):
        data = (tmp_path / f"logs/{n:06d}.log").read_bytes()
        assert [x.batch_rows(b) for b in x.log_payloads(data)] == [[r[1:] for r in rows if r[0] == n], []]
        assert data == x.framed_log(list(x.log_payloads(data)))
    assert _read(x.read_logs(spark, f"file://{tmp_path}/logs")) == _read(x.read_logs(spark, *names)) == [r[1:] for r in rows]


def test_closing_batch_at_the_end_of_a_block(spark, tmp_path):
    """The last batch leaves too little of a block for the closing one, by every number of bytes."""
    sizes = range(x.BLOCK - 80, x.BLOCK - 20)
    rows = [(n, b"k", n + 1, 1, b"v" * size) for n, size in enumerate(sizes)]
    x.write_logs(spark.createDataFrame(rows, "run_id long, user_key binary, seq long, type byte, value binary"), f"file://{tmp_path}/logs")
    assert _read(x.read_logs(spark, f"file://{tmp_path}/logs")) == [r[1:] for r in rows]
    for n in range(len(rows)):
        data = (tmp_path / f"logs/{n:06d}.log").read_bytes()
        assert data == x.framed_log(list(x.log_payloads(data))) and len(list(x.log_payloads(data))) == 2
