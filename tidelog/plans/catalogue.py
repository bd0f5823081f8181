"""Queries over the driver tables, one for each operator, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import bloom, keys
from tidelog.operators import batch, compaction, mvcc, scan
from tidelog.schema import MAX_SEQUENCE, Options
from tidelog.sources import manifest
from tidelog.sources.adapters import conversations_log, events_log, orders_log, with_runs

SNAPSHOT, PIN, RUN_SIZE, LIMIT = 5000, 5000, 1000, 20
TARGET, RANGE, PREFIX, POINT = "user:00000042", ("user:00000020", "user:00000090"), "user:0000004", "user:00000007"
OPTIONS = Options(max_level_bytes=4000, max_level_bytes_multiplier=4, max_num_levels=5)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# the logs and runs as SQL
_EVENTS = (
    "log AS (SELECT printf('user:%08d', user_id) AS user_key, CAST(event_id + 1 AS BIGINT) AS seq, CASE WHEN event_type = 'error' THEN CAST(0 AS TINYINT) ELSE CAST(1 AS TINYINT) END AS type, "
    "CASE WHEN event_type <> 'error' THEN event_type END AS value FROM events)"
)
_ORDERS = (
    "log AS (SELECT printf('cust:%08d', o_custkey) AS user_key, CAST(o_orderkey + 1 AS BIGINT) AS seq, CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS TINYINT) ELSE CAST(1 AS TINYINT) END AS type, "
    "CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS value FROM orders)"
)
_NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM log WHERE seq <= {s}) WHERE rn = 1)"
_VISIBLE = "vis AS (SELECT user_key, value FROM newest WHERE type = 1)"
_RUNS = (
    f"runs AS (SELECT (seq - 1) // {RUN_SIZE} AS run_id, count(*) AS num_entries, CAST(sum(strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS file_size, min(user_key) AS smallest_key, "
    f"max(user_key) AS largest_key, min(seq) AS min_seq, max(seq) AS max_seq, CAST(least((seq - 1) // {RUN_SIZE}, 4) AS INTEGER) AS level FROM log GROUP BY ALL)"
)


def _visible_sql(tail: str, snapshot: int = MAX_SEQUENCE, log: str = _EVENTS) -> str:
    return f"WITH {log}, {_NEWEST.format(s=snapshot)}, {_VISIBLE} {tail}"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _placed(rows: DataFrame, down: bool = False) -> DataFrame:
    """A bounded, ordered result with its place, as results are compared without order."""
    key = F.col("user_key")
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(key.desc() if down else key)).cast("long"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the events log in runs; the oldest four make up a level each, the rest the last."""
    found = compaction.run_metadata(with_runs(events_log(spark, sf_dir), RUN_SIZE))
    return found.withColumn("level", F.least("run_id", F.lit(4)).cast("int"))


# scans


@query(_visible_sql("SELECT * FROM vis"))
def scan_latest(spark, sf_dir):
    return mvcc.visible(events_log(spark, sf_dir))


@query(_visible_sql("SELECT * FROM vis", log=_ORDERS))
def scan_latest_orders(spark, sf_dir):
    return mvcc.visible(orders_log(spark, sf_dir))


@query("SELECT printf('conv:%08d', conv_id) AS user_key, arg_max(role, turn) AS value FROM conversations GROUP BY conv_id")
def scan_latest_conversations(spark, sf_dir):
    return mvcc.visible(conversations_log(spark, sf_dir))


@query(_visible_sql("SELECT * FROM vis", SNAPSHOT))
def scan_snapshot(spark, sf_dir):
    return mvcc.visible(events_log(spark, sf_dir), SNAPSHOT)


@query(_visible_sql("SELECT * FROM vis", 0))
def scan_snapshot_zero(spark, sf_dir):
    return mvcc.visible(events_log(spark, sf_dir), 0)


@query(_visible_sql(f"SELECT *, row_number() OVER (ORDER BY user_key) AS pos FROM vis ORDER BY user_key LIMIT {LIMIT}"))
def scan_forward_pos(spark, sf_dir):
    return _placed(scan.forward(mvcc.visible(events_log(spark, sf_dir)), LIMIT))


@query(_visible_sql(f"SELECT *, row_number() OVER (ORDER BY user_key DESC) AS pos FROM vis ORDER BY user_key DESC LIMIT {LIMIT}"))
def scan_reverse_pos(spark, sf_dir):
    return _placed(scan.backward(mvcc.visible(events_log(spark, sf_dir)), LIMIT), down=True)


@query(_visible_sql(f"SELECT *, row_number() OVER (ORDER BY user_key) AS pos FROM vis WHERE user_key >= '{TARGET}' ORDER BY user_key LIMIT 10"))
def seek_limit(spark, sf_dir):
    return _placed(scan.seek(events_log(spark, sf_dir), TARGET, 10))


@query(_visible_sql(f"SELECT *, row_number() OVER (ORDER BY user_key) AS pos FROM vis WHERE user_key > '{TARGET}' ORDER BY user_key LIMIT 10"))
def page_next(spark, sf_dir):
    return _placed(scan.next_page(events_log(spark, sf_dir), TARGET, 10))


@query(_visible_sql(f"SELECT *, row_number() OVER (ORDER BY user_key DESC) AS pos FROM vis WHERE user_key < '{TARGET}' ORDER BY user_key DESC LIMIT 10"))
def page_previous(spark, sf_dir):
    return _placed(scan.previous_page(events_log(spark, sf_dir), TARGET, 10), down=True)


@query(_visible_sql(f"SELECT * FROM vis WHERE user_key >= '{RANGE[0]}' AND user_key < '{RANGE[1]}'"))
def range_scan(spark, sf_dir):
    return scan.between(events_log(spark, sf_dir), *RANGE)


@query(_visible_sql(f"SELECT * FROM vis WHERE starts_with(user_key, '{PREFIX}')", SNAPSHOT))
def prefix_scan(spark, sf_dir):
    return scan.prefixed(events_log(spark, sf_dir), PREFIX, SNAPSHOT)


@query(_visible_sql(f"SELECT * FROM vis WHERE starts_with(user_key, '{PREFIX}')"))
def prefix_scan_bytes(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("user_key", F.col("user_key").cast("binary"))
    return scan.prefixed(log, PREFIX.encode()).withColumn("user_key", F.col("user_key").cast("string"))


@query(_visible_sql("SELECT min(user_key) AS first_key, max(user_key) AS last_key FROM vis"))
def first_last_key(spark, sf_dir):
    return scan.first_last(events_log(spark, sf_dir))


@query(_visible_sql(f"SELECT max(user_key) FILTER (user_key < '{TARGET}') AS predecessor, min(user_key) FILTER (user_key >= '{TARGET}') AS successor FROM vis"))
def predecessor_successor(spark, sf_dir):
    return scan.around(events_log(spark, sf_dir), TARGET)


# point reads


@query(_visible_sql(f"SELECT * FROM vis WHERE user_key = '{POINT}'"))
def get_point(spark, sf_dir):
    return scan.get(events_log(spark, sf_dir), POINT)


@query(_visible_sql(f"SELECT * FROM vis WHERE user_key = '{POINT}'", SNAPSHOT))
def get_point_snapshot(spark, sf_dir):
    return scan.get(events_log(spark, sf_dir), POINT, SNAPSHOT)


def _asked(spark: SparkSession) -> DataFrame:
    return spark.range(200).select(F.format_string("user:%08d", "id").alias("user_key"))


@query(
    f"WITH {_EVENTS}, {_NEWEST.format(s=SNAPSHOT)}, asked AS (SELECT printf('user:%08d', i) AS user_key FROM range(200) t(i)) "
    "SELECT user_key, CASE WHEN type IS NULL THEN 'absent' WHEN type = 1 THEN 'value' ELSE 'deleted' END AS state, value FROM asked LEFT JOIN newest USING (user_key)"
)
def multi_get_state(spark, sf_dir):
    return scan.multi_get(events_log(spark, sf_dir), _asked(spark), SNAPSHOT)


@query(_visible_sql("SELECT printf('user:%08d', i) AS user_key FROM range(200) t(i) WHERE printf('user:%08d', i) IN (SELECT user_key FROM vis)"))
def contains_keys(spark, sf_dir):
    return scan.contains(events_log(spark, sf_dir), _asked(spark))


# versions and retention


@query(f"WITH {_EVENTS} SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, type DESC) AS pos FROM log")
def version_history(spark, sf_dir):
    return mvcc.history(events_log(spark, sf_dir))


@query(f"WITH {_EVENTS}, {_NEWEST.format(s=MAX_SEQUENCE)} SELECT user_key, seq FROM newest WHERE type = 0")
def tombstones_only(spark, sf_dir):
    return mvcc.tombstones(events_log(spark, sf_dir))


@query(_visible_sql("SELECT * FROM vis"))
def merge_runs(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return mvcc.visible(mvcc.merged([log.where(F.pmod("seq", F.lit(3)) == n) for n in (2, 0, 1)]))


_KEPT = f"WITH {_EVENTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_key, seq <= {PIN} ORDER BY seq DESC) AS rn FROM log) SELECT user_key, seq, type, value FROM ranked WHERE (seq > {PIN} OR rn = 1)"


@query(_KEPT)
def compact_mid(spark, sf_dir):
    return mvcc.retained(events_log(spark, sf_dir), PIN)


@query(f"{_KEPT} AND NOT (seq <= {PIN} AND type = 0)")
def compact_bottom(spark, sf_dir):
    return mvcc.retained(events_log(spark, sf_dir), PIN, bottom=True)


@query(_visible_sql("SELECT * FROM vis", PIN + 2000))
def compact_preserves_view(spark, sf_dir):
    return mvcc.visible(mvcc.retained(events_log(spark, sf_dir), PIN, bottom=True), PIN + 2000)


# batches


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one batch, in their order; users in order."""
    op = F.struct("seq", "type", F.col("user_key").alias("key"), "value")
    grouped = events_log(spark, sf_dir).groupBy("user_key").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    return grouped.select(F.col("user_key").alias("batch_id"), F.transform("ops", lambda x: F.struct(x["type"].alias("type"), x["key"].alias("key"), x["value"].alias("value"))).alias("ops"))


@query(f"WITH {_EVENTS} SELECT user_key AS batch_id, 100 + row_number() OVER (ORDER BY user_key, seq) AS seq, type, user_key, value FROM log")
def batch_assign_seq(spark, sf_dir):
    return batch.exploded(_batches(spark, sf_dir), 100)


# runs and levels

_META = "run_id, num_entries, file_size, smallest_key, largest_key, min_seq, max_seq"


@query(f"WITH {_EVENTS}, {_RUNS} SELECT {_META}, level FROM runs")
def run_metadata(spark, sf_dir):
    return _runs(spark, sf_dir)


_STATS = f"WITH {_EVENTS}, {_RUNS}, stats AS (SELECT CAST(l AS INTEGER) AS level, count(run_id) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM range({OPTIONS.max_num_levels}) t(l) LEFT JOIN runs ON level = l GROUP BY l)"
_PRESSURE = f"pressures AS (SELECT *, CASE WHEN level = 0 THEN files / {OPTIONS.l0_compaction_trigger}.0 ELSE bytes / ({OPTIONS.max_level_bytes}.0 * pow({OPTIONS.max_level_bytes_multiplier}.0, level - 1)) END AS pressure FROM stats)"


@query(f"{_STATS} SELECT * FROM stats")
def level_stats(spark, sf_dir):
    return compaction.level_stats(spark, _runs(spark, sf_dir), OPTIONS)


@query(f"{_STATS} SELECT CAST(sum(files) AS BIGINT) AS files FROM stats")
def num_table_files(spark, sf_dir):
    return _runs(spark, sf_dir).agg(F.count("*").alias("files"))


@query(f"{_STATS}, {_PRESSURE} SELECT level FROM pressures WHERE pressure > 1 AND level < {OPTIONS.max_num_levels - 1} ORDER BY pressure DESC, level LIMIT 1")
def pick_level(spark, sf_dir):
    return compaction.pick_level(compaction.level_stats(spark, _runs(spark, sf_dir), OPTIONS), OPTIONS).select("level")


@query(f"SELECT CAST(l AS INTEGER) AS level, CASE WHEN l = 0 THEN 0.0 ELSE least({OPTIONS.max_level_bytes}.0 * pow({OPTIONS.max_level_bytes_multiplier}.0, l - 1), 9223372036854775807.0) END AS capacity FROM range({OPTIONS.max_num_levels}) t(l)")
def level_capacities(spark, sf_dir):
    levels = spark.range(OPTIONS.max_num_levels).select(F.col("id").cast("int").alias("level"))
    return levels.select("level", compaction.capacity_column(F.col("level"), OPTIONS).alias("capacity"))


@query("SELECT n_nationkey, (n_nationkey * 10 >= n_regionkey * 40) AND n_nationkey < 16 AS throttled FROM nation")
def throttle_decision(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    held = compaction.throttled_column(F.col("n_nationkey") * 10, F.col("n_regionkey") * 40, F.col("n_nationkey"), OPTIONS)
    return nation.select("n_nationkey", held.alias("throttled"))


@query(f"WITH {_EVENTS}, {_RUNS} SELECT a.run_id AS left_id, b.run_id AS right_id FROM runs a, runs b WHERE a.run_id <> b.run_id AND a.smallest_key <= b.largest_key AND a.largest_key >= b.smallest_key")
def overlapping_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return compaction.overlapping(runs, runs)


@query(f"WITH {_EVENTS}, {_RUNS}, own AS (SELECT * FROM runs WHERE level = 1 ORDER BY run_id LIMIT 1) SELECT run_id FROM own UNION ALL SELECT r.run_id FROM runs r, own WHERE r.level = 2 AND r.smallest_key <= own.largest_key AND r.largest_key >= own.smallest_key")
def compaction_inputs(spark, sf_dir):
    return compaction.inputs(_runs(spark, sf_dir), 1).select("run_id")


@query(f"WITH {_EVENTS}, {_RUNS} SELECT CAST(coalesce(sum(file_size) FILTER (largest_key < 'user:00000148'), 0) AS BIGINT) AS \"offset\" FROM runs")
def approx_offset(spark, sf_dir):
    return compaction.approximate_offset(_runs(spark, sf_dir), "user:00000148").withColumn("offset", F.col("offset").cast("long"))


@query(f"WITH {_EVENTS} SELECT CAST(sum(1 + strlen(user_key) + 8 + 1 + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM log")
def memory_usage(spark, sf_dir):
    return compaction.memory_usage(events_log(spark, sf_dir))


@query(f"WITH {_EVENTS}, kept AS (SELECT *, row_number() OVER (PARTITION BY user_key, seq <= {PIN} ORDER BY seq DESC) AS rn FROM log) SELECT round(count(*) FILTER (seq > {PIN} OR rn = 1) / count(*), 9) AS ratio FROM kept")
def write_amplification(spark, sf_dir):
    log = events_log(spark, sf_dir)
    both = log.select(F.lit(0).alias("kept"), F.lit(1).alias("all")).unionAll(mvcc.retained(log, PIN).select(F.lit(1), F.lit(0)))
    return both.agg(F.sum("kept").alias("kept"), F.sum("all").alias("all")).select(F.round(compaction.write_amplification(F.col("kept"), F.col("all")), 9).alias("ratio"))


@query("SELECT coalesce(min(event_id) FILTER (event_type = 'purchase'), 72057594037927935) AS earliest FROM events")
def earliest_snapshot(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return compaction.earliest_pin(events.where("event_type = 'purchase'").select(F.col("event_id").alias("seq")), MAX_SEQUENCE)


# manifest

_EDITS = "edits AS (SELECT o_orderkey AS version, o_orderkey * 2 AS added, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS removed FROM orders)"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    return orders.select(key.alias("version"), F.array(key * 2).alias("new_files"), F.when(key % 3 == 0, F.array(key)).otherwise(F.array().cast("array<bigint>")).alias("deleted_files"))


@query(f"WITH {_EDITS} SELECT DISTINCT added AS run_id FROM edits WHERE added NOT IN (SELECT removed FROM edits WHERE removed IS NOT NULL)")
def manifest_replay(spark, sf_dir):
    return manifest.replayed(_edits(spark, sf_dir))


@query(f"WITH {_EDITS}, live AS (SELECT added FROM edits WHERE added NOT IN (SELECT removed FROM edits WHERE removed IS NOT NULL)) SELECT printf('run-%08d', o_orderkey) AS name, o_orderkey AS run_id FROM orders WHERE o_orderkey NOT IN (SELECT added FROM live)")
def orphan_files(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    listing = orders.select(F.format_string("run-%08d", "o_orderkey").alias("name")).union(spark.createDataFrame([("LOCK",), ("run-7",)], "name string"))
    return manifest.orphans(listing, manifest.replayed(_edits(spark, sf_dir)))


# functions


@query(f"WITH {_EVENTS} SELECT user_key, seq * 256 + type AS packed, '''' || user_key || ''' @ ' || seq || ' : ' || type AS text, seq, CAST(type AS INTEGER) AS type FROM log")
def internal_key_pack(spark, sf_dir):
    log = events_log(spark, sf_dir)
    packed = log.select("user_key", keys.pack(F.col("seq"), F.col("type")).alias("packed"), keys.debug_string(F.col("user_key"), F.col("seq"), F.col("type")).alias("text"))
    seq, kind = keys.unpack(F.col("packed"))
    return packed.withColumns({"seq": seq, "type": kind.cast("int")})


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3 ELSE CAST(4 AS BIGINT) END AS n FROM orders")
def varint_length(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", keys.varint_length(F.col("o_orderkey")).alias("n"))


# of an integer and of a string
_VARINT = (
    "CASE WHEN {k} < 128 THEN printf('%02X', {k}) WHEN {k} < 16384 THEN printf('%02X%02X', ({k} & 127) | 128, {k} >> 7) "
    "WHEN {k} < 2097152 THEN printf('%02X%02X%02X', ({k} & 127) | 128, (({k} >> 7) & 127) | 128, {k} >> 14) "
    "ELSE printf('%02X%02X%02X%02X', ({k} & 127) | 128, (({k} >> 7) & 127) | 128, (({k} >> 14) & 127) | 128, {k} >> 21) END"
)
_BYTES = "list_transform(range(1, len({k}) + 1), lambda i: ascii(substr({k}, i, 1)))"
_FNV = f"CAST(list_reduce({_BYTES}, lambda h, byte: (xor(h, byte) * 16777619) % 4294967296, 2166136261) AS BIGINT)"
_CRC = (
    f"CAST(xor(list_reduce({_BYTES}, lambda crc, byte: list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 2197175160) ELSE r >> 1 END, xor(crc, byte)), 4294967295), 4294967295) AS BIGINT)"
)


@query(f"SELECT o_orderkey, {_VARINT.format(k='o_orderkey')} AS encoded, o_orderkey AS back FROM orders")
def varint_roundtrip(spark, sf_dir):
    encoded = keys.varint_column(F.col("o_orderkey"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.hex(encoded).alias("encoded"), keys.read_varint_column(encoded).alias("back"))


@query("SELECT o_orderkey, (o_orderkey % 128) + 128 * (o_custkey % 128) AS value, CAST(NULL AS BIGINT) AS cut FROM orders")
def varint_decode(spark, sf_dir):
    """Two bytes made by hand, the first with its top bit set, and the first alone."""
    low, high = F.lpad(F.hex(F.col("o_orderkey") % 128 + 128), 2, "0"), F.lpad(F.hex(F.col("o_custkey") % 128), 2, "0")
    value, cut = keys.read_varint_column(F.unhex(F.concat(low, high))), keys.read_varint_column(F.unhex(low))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", value.alias("value"), cut.alias("cut"))


@query("SELECT c_name, printf('%02X', strlen(c_name)) || hex(c_name) AS framed, c_name AS back, left(c_name, 10) AS first, CAST(NULL AS VARCHAR) AS cut FROM customer")
def length_prefix_roundtrip(spark, sf_dir):
    """A name framed, read back, read from a frame made by hand with more behind it, and from one that is cut off."""
    name = F.col("c_name").cast("binary")
    framed = keys.length_prefixed_column(name)
    first, cut = (keys.read_length_prefixed_column(F.concat(F.unhex(F.lit(n)), name)).cast("string") for n in ("0A", "7F"))
    back = keys.read_length_prefixed_column(framed).cast("string")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name", F.hex(framed).alias("framed"), back.alias("back"), first.alias("first"), cut.alias("cut"))


@query(
    "SELECT o_orderkey, printf('%02X%02X%02X%02X', o_orderkey & 255, (o_orderkey >> 8) & 255, (o_orderkey >> 16) & 255, (o_orderkey >> 24) & 255) AS fixed32, o_orderkey AS back32, "
    "printf('%02X%02X%02X', o_orderkey & 255, (o_orderkey >> 8) & 255, (o_orderkey >> 16) & 255) || '0000000000' AS fixed64, -o_orderkey AS back64 FROM orders"
)
def fixed_codec(spark, sf_dir):
    """Both widths encoded, and numbers read back from them, negative ones too."""
    key = F.col("o_orderkey")
    half, whole = keys.fixed_column(key, 32), keys.fixed_column(key)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.hex(half).alias("fixed32"), keys.read_fixed_column(half, 32).alias("back32"), F.hex(whole).alias("fixed64"), keys.read_fixed_column(keys.fixed_column(-key)).alias("back64")
    )


@query("SELECT o_orderkey, printf('%02X%02X%02X', o_orderkey & 255, (o_orderkey >> 8) & 255, (o_orderkey >> 16) & 255) || '0000000000' AS fixed FROM orders")
def fixed64_encode(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", keys.fixed64_hex(F.col("o_orderkey")).alias("fixed"))


@query("SELECT c_name, substr(c_name, 10) AS rest, strlen(c_name) AS size, starts_with(c_name, 'Customer#0000') AS starts, c_name < 'Customer#000000500' AS below FROM customer")
def slice_functions(spark, sf_dir):
    name = F.col("c_name")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_name", F.substring(name, 10, 1000).alias("rest"), F.octet_length(name).cast("long").alias("size"), name.startswith("Customer#0000").alias("starts"), (name < "Customer#000000500").alias("below")
    )


@query(f"SELECT c_custkey, {_CRC.format(k='c_name')} AS crc FROM customer")
def crc32c_check(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", keys.crc32c_udf(F.col("c_name").cast("binary")).alias("crc"))


@query(f"SELECT c_custkey, {_FNV.format(k='c_name')} AS hash FROM customer")
def bloom_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", keys.fnv1a_udf(F.col("c_name").cast("binary")).alias("hash"))


_PAIRS = "pairs AS (SELECT p_name AS key, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS after, p_partkey FROM part)"
# the last place up to which two keys agree, and the byte behind it
_SAME = f"same AS (SELECT *, list_max(list_filter(range(0, least(strlen(key), strlen(after)) + 1), lambda i: left(key, i) = left(after, i))) AS n FROM pairs WHERE after IS NOT NULL)"
_SHORT = (
    "short AS (SELECT *, CASE WHEN n < least(strlen(key), strlen(after)) AND ascii(substr(key, n + 1, 1)) + 1 < ascii(substr(after, n + 1, 1)) "
    "THEN left(key, n) || chr(ascii(substr(key, n + 1, 1)) + 1) ELSE key END AS separator, chr(ascii(key) + 1) AS successor FROM same)"
)


@query(
    f"WITH {_PAIRS}, {_SAME}, {_SHORT} SELECT p_partkey, separator, successor, CASE WHEN strlen(separator) < strlen(key) AND separator > key THEN separator || '@{MAX_SEQUENCE}' END AS internal, "
    f"CASE WHEN strlen(successor) < strlen(key) THEN successor || '@{MAX_SEQUENCE}' END AS internal_successor FROM short"
)
def separator_check(spark, sf_dir):
    """Keys shortened between the name of each part and the next of its brand, plain and with sequences."""
    order = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").cast("binary").alias("key"), F.lead("p_name").over(order).cast("binary").alias("after"))
    key, after = F.col("key"), F.col("after")
    text = lambda c: F.concat(c["user_key"].cast("string"), F.lit("@"), c["seq"].cast("string"))
    return parts.where("after is not null").select(
        "p_partkey",
        keys.short_separator_column(key, after).cast("string").alias("separator"),
        keys.short_successor_column(key).cast("string").alias("successor"),
        text(keys.internal_separator_column(key, after)).alias("internal"),
        text(keys.internal_successor_column(key)).alias("internal_successor"),
    )


_PROBES = bloom.probes_for(10)


@query(
    f"WITH present AS (SELECT DISTINCT printf('user:%08d', user_id) AS user_key FROM events), size AS (SELECT greatest(64, (count(*) * 10 + 7) // 8 * 8) AS m FROM present), "
    f"hashed AS (SELECT user_key, {_FNV.format(k='user_key')} AS h FROM present UNION ALL SELECT user_key, {_FNV.format(k='user_key')} FROM (SELECT printf('absent:%08d', user_id) AS user_key FROM events GROUP BY user_id)), "
    f"probes AS (SELECT user_key, (h + j * ((h >> 17) | ((h << 15) & 4294967295))) % 4294967296 % m AS bit FROM hashed, size, range({_PROBES}) t(j)), "
    "bits AS (SELECT DISTINCT bit FROM probes WHERE starts_with(user_key, 'user:')) "
    "SELECT user_key, count(bits.bit) = count(*) AS may_hold FROM probes LEFT JOIN bits USING (bit) GROUP BY user_key"
)
def bloom_probe(spark, sf_dir):
    """A filter of the users, asked for all of them and for as many keys that are not there."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    named = lambda kind: users.select(F.format_string(f"{kind}:%08d", "user_id").cast("binary").alias("user_key"))
    asked = named("user").unionAll(named("absent"))
    return bloom.probe(asked, bloom.build(named("user"))).withColumn("user_key", F.col("user_key").cast("string"))
