"""Queries that go through a store, its streams or its file formats, over whole driver tables, with their DuckDB SQL."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import SHORTLEX
from tidelog.operators import mvcc
from tidelog.operators.batch import WriteBatch, appended
from tidelog.plans.catalogue import _EVENTS, _RUNS, RUN_SIZE, SNAPSHOT, _runs, _visible_sql, query
from tidelog.schema import LOG, NotFound, Options
from tidelog.sources import interchange
from tidelog.sources.adapters import events_log, with_runs
from tidelog.sources.scratch import scratch_folder
from tidelog.store import VersionedStore
from tidelog.streaming import tail

NEW = Options(create_if_missing=True, l0_compaction_trigger=1, max_write_amplification=-1, max_run_bytes=20_000)
_NATION = "SELECT printf('nation:%02d', n_nationkey) AS user_key, n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation"
_NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of events with keys and values as bytes."""
    return events_log(spark, sf_dir).select(F.col("user_key").cast("binary").alias("user_key"), "seq", "type", F.col("value").cast("binary").alias("value"))


def _open(spark: SparkSession, **options) -> VersionedStore:
    return VersionedStore.open(spark, scratch_folder(spark, "store"), Options(**{**NEW.__dict__, **options}))


def _filled(spark: SparkSession, sf_dir: str) -> VersionedStore:
    """A store with the events in four bulk writes, so that sequences are those of the log."""
    store, log = _open(spark), _events(spark, sf_dir)
    last = log.agg(F.max("seq").alias("last")).first().last or 0
    for n in range(4):
        store.write_frame(log.where((F.col("seq") > last * n // 4) & (F.col("seq") <= last * (n + 1) // 4)), "seq")
    return store


def _text(rows: DataFrame) -> DataFrame:
    """Keys and values as strings."""
    return rows.withColumns({c: F.col(c).cast("string") for c in ("user_key", "value") if c in rows.columns})


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The 25 nations."""
    return [(f"nation:{r.n_nationkey:02d}".encode(), r.n_name.encode(), r.n_regionkey) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]


@query(_visible_sql("SELECT * FROM vis"))
def store_bulk_scan(spark, sf_dir):
    """Bulk writes, then a scan of the store."""
    with _filled(spark, sf_dir) as store:
        return _text(store.scan())


@query(f"WITH {_EVENTS}, {_NEWEST} SELECT user_key, seq, type, value FROM newest WHERE type = 1")
def store_compact_levels(spark, sf_dir):
    """All records left after compaction down to the levels' capacities, without a snapshot that pins older ones."""
    with _filled(spark, sf_dir) as store:
        while (level := store._level_to_compact(True)) is not None:
            store.compact_level(level)
        return _text(store.log())


@query(f"WITH {_EVENTS} SELECT count(*) AS num_entries, min(seq) AS min_seq, max(seq) AS max_seq, min(user_key) AS smallest_key, max(user_key) AS largest_key, true AS apart FROM log WHERE (user_key, seq) IN (SELECT (user_key, max(seq)) FROM log GROUP BY user_key) AND type = 1")
def store_run_metadata(spark, sf_dir):
    """What the runs of level 1 say after one compaction: their sums and ends, and that no two of them share a key."""
    with _filled(spark, sf_dir) as store:
        store.compact_level(0)
        runs = sorted((r for r in store.state.runs if r.level == 1), key=lambda r: r.smallest_key)
        apart = all(a.largest_key < b.smallest_key for a, b in zip(runs, runs[1:])) and len(runs) == store.level_file_counts()[1]
        rows = store.runs().where("level = 1").agg(
            F.sum("num_entries").alias("num_entries"), F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"),
            F.min("smallest_key").cast("string").alias("smallest_key"), F.max("largest_key").cast("string").alias("largest_key"),
        )
        return rows.withColumn("apart", F.lit(apart))


@query(_visible_sql("SELECT * FROM vis"))
def store_snapshot_survives(spark, sf_dir):
    """A pinned view after every key was deleted and all was compacted."""
    with _filled(spark, sf_dir) as store:
        pin = store.snapshot()
        keys = mvcc.visible_keys(store.log()).select("user_key", F.lit(0).alias("type"), F.lit(None).cast("binary").alias("value"))
        store.write_frame(keys, "user_key")
        store.compact()
        return _text(store.scan(snapshot=pin.seq))


@query(f"WITH {_EVENTS}, {_NEWEST} SELECT CAST(0 AS BIGINT) AS visible, 2 * count(*) FILTER (type = 1) AS kept FROM newest")
def store_snapshot_pins(spark, sf_dir):
    """Keys visible after all were deleted, and records that compaction kept because a snapshot pins them."""
    with _filled(spark, sf_dir) as store:
        store.compact_level(0)
        store.snapshot()
        keys = mvcc.visible_keys(store.log()).select("user_key", F.lit(0).alias("type"), F.lit(None).cast("binary").alias("value"))
        store.write_frame(keys, "user_key")
        store.compact_level(0)
        return store.log().agg(F.count("*").alias("kept")).withColumn("visible", F.lit(store.scan().count()))


@query(f"WITH n AS ({_NATION}) SELECT user_key, CASE WHEN region = 0 THEN 'NotFound' ELSE 'value' END AS state, CASE WHEN region <> 0 THEN name || CASE WHEN region = 1 THEN '!' ELSE '' END END AS value, name AS before FROM n")
def store_put_get_delete(spark, sf_dir):
    """A put of each nation, a delete of those of one region, a second put of another's, and reads now and before."""
    with _open(spark) as store:
        listed = _nations(spark, sf_dir)
        for key, name, _ in listed:
            before = store.put(key, name)
        for key, name, region in listed:
            if region == 0:
                store.delete(key)
            elif region == 1:
                store.put(key, name + b"!")
        rows = []
        for key, _, _ in listed:
            try:
                state, value = "value", store.get(key).decode()
            except NotFound as missing:
                state, value = missing.status, None
            rows.append((key.decode(), state, value, store.get(key, before).decode()))
        return spark.createDataFrame(rows, "user_key string, state string, value string, before string")


@query(
    f"WITH n AS ({_NATION}), ops AS (SELECT 0 AS part, key AS nr, user_key, CAST(1 AS TINYINT) AS type, name AS value FROM n UNION ALL SELECT 1, key, user_key, CAST(0 AS TINYINT), NULL FROM n WHERE region = 2) "
    "SELECT user_key, row_number() OVER (ORDER BY part, nr) AS seq, type, value FROM ops"
)
def store_write_batch(spark, sf_dir):
    """One batch joined from two, written as one commit, and the records it became."""
    listed = _nations(spark, sf_dir)
    puts, deletes, joined = WriteBatch(), WriteBatch(), WriteBatch()
    for key, name, region in listed:
        puts.put(key, name)
        if region == 2:
            deletes.delete(key)
    puts.append(deletes).iterate(joined)
    with _open(spark) as store:
        store.write(WriteBatch.decoded(joined.encoded(1)))
        return _text(store.log())


@query(f"WITH n AS ({_NATION}) SELECT user_key, name AS value FROM n WHERE region <> 3")
def store_recovers(spark, sf_dir):
    """What the next writer sees after one has died with a run written but not committed, and again after a flush of its own."""
    store = _open(spark, lease_seconds=0.5)
    for key, name, _ in (listed := _nations(spark, sf_dir)):
        store.put(key, name)
    store.flush()
    for key, _, region in listed:
        if region == 3:
            store.delete(key)

    def stop(name: str) -> None:
        if name == "run named":
            raise InterruptedError(name)

    store.step = stop
    try:
        store.flush()
    except InterruptedError:
        store._stop_renewing()
    time.sleep(1)
    with VersionedStore.open(spark, store.root, Options(lease_seconds=0.5)) as again:
        again.flush()
    with VersionedStore.open(spark, store.root, read_only=True) as reader:
        return _text(reader.scan())


@query(_visible_sql("SELECT * FROM vis WHERE user_key >= 'user:00000020' AND user_key < 'user:00000090'", SNAPSHOT))
def store_range_at_snapshot(spark, sf_dir):
    with _filled(spark, sf_dir) as store:
        return _text(store.scan(b"user:00000020", b"user:00000090", snapshot=SNAPSHOT))


@query(
    f"WITH {_EVENTS}, {_NEWEST}, asked AS (SELECT printf('user:%08d', i) AS user_key FROM range(200) t(i)) "
    "SELECT user_key, CASE WHEN type IS NULL THEN 'absent' WHEN type = 1 THEN 'value' ELSE 'deleted' END AS state, value FROM asked LEFT JOIN newest USING (user_key)"
)
def store_multi_get(spark, sf_dir):
    with _filled(spark, sf_dir) as store:
        asked = spark.range(200).select(F.format_string("user:%08d", "id").cast("binary").alias("user_key"))
        return _text(store.multi_get(asked))


@query(f"WITH {_EVENTS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM log WHERE seq <= least(1000000000, (SELECT max(seq) FROM log))) WHERE rn = 1) SELECT user_key, value FROM newest WHERE type = 1")
def scan_clamped_snapshot(spark, sf_dir):
    """A read at a sequence that is not written yet sees the last one at the time of the call, not what comes after."""
    with _filled(spark, sf_dir) as store:
        rows = store.scan(snapshot=1_000_000_000)
        keys = mvcc.visible_keys(store.log()).select("user_key", F.lit(0).alias("type"), F.lit(None).cast("binary").alias("value"))
        store.write_frame(keys, "user_key")
        return _text(rows)


@query(_visible_sql("SELECT *, row_number() OVER (ORDER BY user_key DESC) AS pos FROM vis ORDER BY user_key DESC LIMIT 20"))
def store_reverse_cursor(spark, sf_dir):
    with _filled(spark, sf_dir) as store:
        rows = [(bytes(r.user_key).decode(), bytes(r.value).decode(), n) for n, r in enumerate(store.cursor(reverse=True, limit=20), 1)]
        return spark.createDataFrame(rows, "user_key string, value string, pos long")


@query(f"WITH {_EVENTS} SELECT user_key, seq, type, value FROM log")
def store_single_runs(spark, sf_dir):
    """All versions and tombstones, each run read alone by its own cursor."""
    with _filled(spark, sf_dir) as store:
        return _text(mvcc.merged([store.run_cursor(r.run_id) for r in store.state.runs]))


@query(
    "WITH log AS (SELECT CAST(user_id AS VARCHAR) AS user_key, event_id + 1 AS seq, event_type AS value FROM events), "
    "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND value <> 'error') "
    "SELECT user_key, value, row_number() OVER (ORDER BY strlen(user_key), user_key) AS pos FROM newest WHERE strlen(user_key) > 1 AND (strlen(user_key), user_key) < (3, '110')"
)
def store_custom_order(spark, sf_dir):
    """A range of a store whose keys are ordered by length first, after a compaction."""
    ops = _events(spark, sf_dir).withColumn("user_key", F.regexp_replace(F.col("user_key").cast("string"), "^user:0*(?=.)", ""))
    with _open(spark, comparator=SHORTLEX) as store:
        store.write_frame(ops, "seq")
        store.compact_level(0)
        rows = [(bytes(r.user_key).decode(), bytes(r.value).decode(), n) for n, r in enumerate(store.cursor(start=b"10", end=b"110"), 1)]
        return spark.createDataFrame(rows, "user_key string, value string, pos long")


# streams


@query(_visible_sql("SELECT * FROM vis"))
def stream_apply(spark, sf_dir):
    """The log as a stream of files, committed batch by batch; the first batch comes twice."""
    folder, checkpoint = scratch_folder(spark, "changes"), scratch_folder(spark, "stream")
    _events(spark, sf_dir).repartitionByRange(3, "seq").write.parquet(folder)
    with _open(spark) as store:
        tail.apply_to(store, tail.read(spark, folder), checkpoint, "seq").awaitTermination()
        store.write_frame(spark.read.schema(LOG).parquet(folder), "seq", stream=(checkpoint, 0))
        return _text(store.scan())


@query(f"WITH {_EVENTS}, {_NEWEST} SELECT user_key, seq, type, value FROM newest")
def stream_latest(spark, sf_dir):
    """The newest record of each key, folded by the stateful stream over files that come one by one."""
    folder, out = scratch_folder(spark, "changes"), scratch_folder(spark, "latest")
    _events(spark, sf_dir).repartition(3, "seq").write.parquet(folder)
    tail.drain(tail.latest(tail.read(spark, folder, 1)), lambda df, _: df.write.mode("append").parquet(out), scratch_folder(spark, "stream"))
    return _text(mvcc.newest(spark.read.schema(LOG).parquet(out)))


# file formats


@query(f"WITH {_EVENTS} SELECT user_key, seq, type, value FROM log")
def table_files(spark, sf_dir):
    """The log written as sorted table files, a run each, and read back."""
    folder = scratch_folder(spark, "tables")
    interchange.write_tables(with_runs(_events(spark, sf_dir), RUN_SIZE), folder)
    return _text(interchange.read_tables(spark, folder))


@query(f"WITH {_EVENTS} SELECT user_key, seq, type, value FROM log")
def log_files(spark, sf_dir):
    """The log written as framed files of batches, a run each, and read back."""
    folder = scratch_folder(spark, "logs")
    interchange.write_logs(with_runs(_events(spark, sf_dir), RUN_SIZE), folder)
    return _text(interchange.read_logs(spark, folder))


@query(f"WITH {_EVENTS}, {_RUNS} SELECT run_id, level, file_size, smallest_key, largest_key FROM runs WHERE run_id % 3 <> 1")
def manifest_file(spark, sf_dir):
    """Binary edits that add every run and remove one in three, framed as a file, parsed and replayed."""
    runs = _runs(spark, sf_dir).orderBy("run_id").collect()
    edits = [interchange.encoded_edit(comparator="bytewise", log_number=0, last_sequence=0)]
    for r in runs:
        run = {"run_id": r.run_id, "level": r.level, "file_size": r.file_size, "smallest_key": r.smallest_key.encode(), "largest_key": r.largest_key.encode(), "min_seq": r.min_seq, "max_seq": r.max_seq}
        edits.append(interchange.encoded_edit(new_files=[run], last_sequence=r.max_seq))
    edits += [interchange.encoded_edit(deleted_files=[r.run_id]) for r in runs if r.run_id % 3 == 1]
    live = interchange.live_runs(interchange.framed_log(edits))
    rows = [(f["run_id"], f["level"], f["file_size"], f["smallest_key"].decode(), f["largest_key"].decode()) for f in live.values()]
    return spark.createDataFrame(rows, "run_id long, level int, file_size long, smallest_key string, largest_key string")


@query(
    "WITH b AS (SELECT event_type AS batch_id, max(event_id) FILTER (value > 50) AS last FROM events GROUP BY event_type) "
    "SELECT batch_id, event_id + CASE WHEN value > 50 THEN 0 ELSE coalesce(last + 1, 0) END AS place, event_id FROM events JOIN b ON event_type = batch_id WHERE value IS NOT NULL"
)
def batch_append(spark, sf_dir):
    """Two batches for each type of event, the second behind the first: operations with their places."""
    ops = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("batch_id"), F.col("event_id").alias("place"), "event_id", "value")
    return appended(ops.where("value > 50").drop("value"), ops.where("value <= 50").drop("value"))
