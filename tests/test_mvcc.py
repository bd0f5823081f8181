from __future__ import annotations

import random

import pytest

from tests.conftest import pairs
from tidelog.operators import mvcc, scan
from tidelog.schema import MAX_SEQUENCE


def model(rows, snapshot):
    best = {}
    for k, s, v in rows:
        if s <= snapshot and (k not in best or s > best[k][0]):
            best[k] = (s, v)
    return sorted((k, v) for k, (_, v) in best.items() if v is not None)


@pytest.mark.parametrize(("snapshot", "value"), [(100, "C"), (20, "C"), (19, "B"), (9, "B"), (5, "A"), (4, None), (0, None)])
def test_version_boundaries(log, snapshot, value):
    rows = log(("k", 5, "A"), ("k", 9, "B"), ("k", 20, "C"))
    assert pairs(mvcc.visible(rows, snapshot)) == ([("k", value)] if value else [])


def test_tombstone_hides_all_older_versions(log):
    rows = log(("gone", 3, "old"), ("gone", 7, None), ("kept", 1, "yes"))
    assert pairs(scan.forward(mvcc.visible(rows, 100))) == [("kept", "yes")]
    assert pairs(scan.forward(mvcc.visible(rows, 6))) == [("gone", "old"), ("kept", "yes")]
    assert pairs(scan.forward(mvcc.visible(rows, 2))) == [("kept", "yes")]


def test_put_after_delete_is_visible_again(log):
    assert pairs(mvcc.visible(log(("k", 1, "a"), ("k", 2, None), ("k", 3, "b")))) == [("k", "b")]


def test_visibility_does_not_depend_on_the_run(log):
    old, new = log(("x", 5, "v"), ("y", 1, "o")), log(("x", 9, None), ("y", 50, "n"))
    for runs in ([old, new], [new, old]):
        assert pairs(mvcc.visible(mvcc.merged(runs))) == [("y", "n")]


def test_seek_range_prefix_and_mirror(log):
    rows = log(("a", 1, "1"), ("c", 2, "2"), ("e", 3, "3"), ("ea", 4, "4"), ("f", 5, None))
    keys = lambda df: [k for k, _ in pairs(df)]
    assert keys(scan.seek(rows, b"cc")) == ["e", "ea"]
    assert keys(scan.seek(rows, b"0", 1)) == ["a"]
    assert keys(scan.seek(rows, b"z")) == []
    assert keys(scan.forward(scan.between(rows, b"a", b"e"))) == ["a", "c"]
    assert keys(scan.forward(scan.prefixed(rows, b"e"))) == ["e", "ea"]
    assert keys(scan.backward(mvcc.visible(rows))) == ["ea", "e", "c", "a"]
    assert keys(scan.next_page(rows, b"c", 1)) == ["e"]
    assert keys(scan.previous_page(rows, b"c", 5)) == ["a"]
    around = scan.around(rows, b"d").first()
    assert (bytes(around.predecessor), bytes(around.successor)) == (b"c", b"e")


def test_multi_get_tells_deleted_from_absent(spark, log):
    rows = log(("a", 1, "1"), ("b", 2, "2"), ("b", 3, None))
    keys = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"c"),)], "user_key binary")
    got = {bytes(r.user_key): r.state for r in scan.multi_get(rows, keys).collect()}
    assert got == {b"a": "value", b"b": "deleted", b"c": "absent"}


def test_point_read_pushes_key_and_snapshot_down(spark, log, tmp_path):
    path = str(tmp_path / "run")
    log(("a", 1, "1")).write.parquet(path)
    plan = scan.get(spark.read.parquet(path), b"a", 7)._jdf.queryExecution().toString()
    assert "EqualTo(user_key" in plan and "LessThanOrEqual(seq,7)" in plan


@pytest.mark.parametrize("seed", range(3))
def test_random_histories(log, seed):
    """Views equal a plain model for every snapshot, and retention changes none from the pin on."""
    rng = random.Random(seed)
    rows = [(rng.choice("abcd"), s, rng.choice([None, f"v{s}"])) for s in range(1, 25)]
    pin = rng.randrange(1, 25)
    parts = [[], [], []]
    for r in rows:
        rng.choice(parts).append(r)
    whole = mvcc.merged([log(*p) for p in parts if p]).cache()
    kept = {bottom: mvcc.retained(whole, pin, bottom).cache() for bottom in (False, True)}
    for snapshot in (0, 1, pin - 1, pin, pin + 1, 24, MAX_SEQUENCE):
        assert sorted(pairs(mvcc.visible(whole, snapshot))) == model(rows, snapshot)
        if snapshot >= pin:
            for frame in kept.values():
                assert sorted(pairs(mvcc.visible(frame, snapshot))) == model(rows, snapshot)


def test_a_tombstone_above_the_pin_survives_the_bottom_level(log):
    rows = log(("k", 1, "old"), ("k", 5, None))
    kept = mvcc.retained(rows, 2, bottom=True)
    assert pairs(mvcc.visible(kept)) == [] and pairs(mvcc.visible(kept, 2)) == [("k", "old")]


def test_key_only_reads_do_not_scan_values(spark, log, tmp_path):
    path = str(tmp_path / "run")
    log(("a", 1, "1"), ("b", 2, "2"), ("b", 3, None)).write.parquet(path)
    rows = spark.read.parquet(path)
    keys = mvcc.visible_keys(rows)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "value" not in plan
    assert [bytes(r.user_key) for r in keys.collect()] == [b"a"]
    assert [(bytes(r.user_key), r.seq) for r in mvcc.tombstones(rows).collect()] == [(b"b", 3)]
