"""Binary interchange: framed logs of write batches, sorted tables and manifest edits, as rows of the log.

For moving data in from stores that keep such files, and out to them. Layouts, numbers little-endian:

* log: blocks of 32 KiB of fragments ``crc32c of type and payload (4), length (2), type (1), payload``, types
  1 whole, 2 first, 3 middle, 4 last; a rest of under 7 bytes in a block is zero.
* batch: ``first sequence (8), count (4)``, then ``1 key value`` or ``0 key``, each length-prefixed.
* table: data blocks, filter, filter index (``filter.`` and a name to its handle), index, footer of 48 bytes (two varint handles, zeros, 8 bytes of
  magic). A block is ``shared, rest, value length (varints), rest of the key, value`` for each entry, then the
  restart offsets and their number (4 each); behind it its crc32c (4) and a byte 1. Keys end in 8 bytes of
  ``sequence << 8 | type``.
"""

from __future__ import annotations

import os
import struct
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.bloom import BloomPolicy, FilterPolicy
from tidelog.functions.keys import crc32c, fixed32, fixed64, length_prefixed, read_length_prefixed, read_varint, varint
from tidelog.schema import DELETE, LOG, PUT, Corruption, IOFailure

# Fixed values of the formats.
BLOCK, HEADER = 32768, 7
WHOLE, FIRST, MIDDLE, LAST = 1, 2, 3, 4
MAGIC, FOOTER, TRAILER = 0xDB4775248B80FB57, 48, 5
#: Files that the driver renames at a time.
RENAMES = 8

Row = tuple[bytes, int, int, bytes | None]


# logs


def log_payloads(data: bytes, verify: bool = True, report: Callable[[int, str], None] | None = None) -> Iterator[bytes]:
    """The records of a log. A torn end, as a crash leaves it, is left out; damage before it is an error.

    With ``report`` damage is not an error: it is told the bytes that are dropped and why, and reading goes
    on at the next block, or behind a sound fragment that is out of place.
    """
    at, parts = 0, []

    def damaged(reason: str) -> int:
        """Where to go on behind damage in the fragment at ``at``."""
        if report is None:
            raise Corruption(reason)
        after = min(len(data), at - at % BLOCK + BLOCK)
        report(after - at + sum(map(len, parts)), reason)
        parts.clear()
        return after

    while at < len(data):
        left = BLOCK - at % BLOCK
        if left < HEADER:
            at += left
            continue
        if at + HEADER > len(data):
            return
        crc, size, kind = struct.unpack_from("<IHB", data, at)
        if kind == 0 and size == 0:
            at += left
            continue
        if size > left - HEADER:
            at = damaged(f"fragment at {at} crosses its block")
            continue
        payload = data[at + HEADER : at + HEADER + size]
        if len(payload) < size:
            return
        if verify and crc32c(bytes([kind]) + payload) != crc:
            at = damaged(f"fragment at {at} has a wrong checksum")
            continue
        if kind not in (WHOLE, FIRST, MIDDLE, LAST) or (kind in (WHOLE, FIRST)) == bool(parts):
            if report is None:
                raise Corruption(f"fragment at {at} is out of place")
            starts = kind in (WHOLE, FIRST)  # then it is what came before that has no end
            report(sum(map(len, parts)) if starts else size, f"fragment at {at} is out of place")
            parts.clear()
            if not starts:
                at += HEADER + size
                continue
        parts.append(payload)
        if kind in (WHOLE, LAST):
            yield b"".join(parts)
            parts = []
        at += HEADER + size


def framed_log(payloads: list[bytes]) -> bytes:
    out = bytearray()
    for payload in payloads:
        at, first = 0, True
        while first or at < len(payload):
            left = BLOCK - len(out) % BLOCK
            if left < HEADER:
                out += bytes(left)
                left = BLOCK
            piece = payload[at : at + left - HEADER]
            at += len(piece)
            last = at == len(payload)
            kind = (WHOLE if last else FIRST) if first else (LAST if last else MIDDLE)
            out += struct.pack("<IHB", crc32c(bytes([kind]) + piece), len(piece), kind) + piece
            first = False
    return bytes(out)


# batches


def batch_rows(payload: bytes) -> list[Row]:
    if len(payload) < 12:
        raise Corruption("batch is too short")
    first, count = struct.unpack_from("<QI", payload)
    rows, at = [], 12
    try:
        while at < len(payload):
            kind, at = payload[at], at + 1
            if kind not in (PUT, DELETE):
                raise Corruption(f"unknown operation {kind}")
            key, at = read_length_prefixed(payload, at)
            value = None
            if kind == PUT:
                value, at = read_length_prefixed(payload, at)
            rows.append((key, first + len(rows), kind, value))
    except ValueError as cut:
        raise Corruption(str(cut)) from cut
    if len(rows) != count:
        raise Corruption(f"batch of {count} operations has {len(rows)}")
    return rows


def encoded_batch(rows: list[Row]) -> bytes:
    """One batch of rows with consecutive sequences."""
    body = b"".join(bytes([kind]) + length_prefixed(key) + (length_prefixed(value or b"") if kind == PUT else b"") for key, _, kind, value in rows)
    return struct.pack("<QI", rows[0][1] if rows else 0, len(rows)) + body


# tables


def _block(data: bytes, handle: tuple[int, int], verify: bool) -> bytes:
    offset, size = handle
    if offset > len(data) or size > len(data) - offset - TRAILER:
        raise Corruption("block lies outside its file")
    contents = data[offset : offset + size]
    if verify and crc32c(contents) != struct.unpack_from("<I", data, offset + size)[0]:
        raise Corruption(f"block at {offset} has a wrong checksum")
    return contents


def _entries(contents: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """The keys and values of a block from the restart ``at`` on."""
    if len(contents) < 4:
        raise Corruption("block is too short")
    restarts = struct.unpack_from("<I", contents, len(contents) - 4)[0]
    end, key = len(contents) - 4 * (restarts + 1), b""
    if end < 0:
        raise Corruption("block has too many restarts")
    while at < end:
        try:
            shared, at = read_varint(contents, at, 32)
            rest, at = read_varint(contents, at, 32)
            size, at = read_varint(contents, at, 32)
        except ValueError as cut:
            raise Corruption(str(cut)) from cut
        if shared > len(key) or at + rest + size > end:
            raise Corruption("block entry is cut off")
        key = key[:shared] + contents[at : at + rest]
        yield key, contents[at + rest : at + rest + size]
        at += rest + size


def _handle(data: bytes, at: int) -> tuple[tuple[int, int], int]:
    offset, at = read_varint(data, at)
    size, at = read_varint(data, at)
    return (offset, size), at


def table_rows(data: bytes, verify: bool = True) -> Iterator[Row]:
    """All versions and tombstones of a sorted table."""
    if len(data) < FOOTER or struct.unpack_from("<Q", data, len(data) - 8)[0] != MAGIC:
        raise Corruption("no table: its footer is missing")
    try:
        _, at = _handle(data, len(data) - FOOTER)
        index, _ = _handle(data, at)
        blocks = [_handle(value, 0)[0] for _, value in _entries(_block(data, index, verify))]
    except ValueError as cut:
        raise Corruption(str(cut)) from cut
    for handle in blocks:
        for key, value in _entries(_block(data, handle, verify)):
            if len(key) < 8 or key[-8] not in (PUT, DELETE):
                raise Corruption("table key is not an internal key")
            packed = struct.unpack("<Q", key[-8:])[0]
            yield key[:-8], packed >> 8, packed & 255, value if packed & 255 == PUT else None


#: Entries of a block from one whole key to the next.
RESTART = 16


def _built(entries: list[tuple[bytes, bytes]], every: int = RESTART) -> bytes:
    """A block whose keys leave out what they share with the one before, but for each ``every``-th."""
    out, restarts, before = bytearray(), [], b""
    for n, (key, value) in enumerate(entries):
        shared = 0
        if n % every == 0:
            restarts.append(len(out))
        else:
            shared = len(os.path.commonprefix([before, key]))
        out += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        before = key
    return bytes(out) + b"".join(map(fixed32, restarts or [0])) + fixed32(max(1, len(restarts)))


def encoded_table(rows: list[Row], block_size: int = 4096, policy: FilterPolicy | None = BloomPolicy()) -> bytes:
    """A table of ``rows``, sorted here; with a filter over its user keys by ``policy``, if there is one."""
    out, index, held, size = bytearray(), [], [], 0

    def put(contents: bytes) -> bytes:
        handle = varint(len(out)) + varint(len(contents))
        out.extend(contents + fixed32(crc32c(contents)) + b"\1")
        return handle

    def flush() -> None:
        nonlocal held, size
        if held:
            index.append((held[-1][0], put(_built(held))))
            held, size = [], 0

    for key, seq, kind, value in sorted(rows, key=lambda r: (r[0], -r[1], -r[2])):
        held.append((key + fixed64(seq << 8 | kind), value or b""))
        size += len(key) + len(value or b"") + 11
        if size >= block_size:
            flush()
    flush()
    filters = []
    if rows and policy is not None:
        filters.append((b"filter." + policy.name.encode(), put(policy.create([r[0] for r in rows]))))
    footer = put(_built(filters)) + put(_built(index, 1))
    return bytes(out) + footer.ljust(FOOTER - 8, b"\0") + fixed64(MAGIC)


def table_filter(data: bytes, name: str = "bloom") -> bytes | None:
    """The filter of that name in a table; None if it has none. A damaged one is an error, as it could hide keys."""
    filters, _ = _handle(data, len(data) - FOOTER)
    for key, handle in _entries(_block(data, filters, True)):
        if key == b"filter." + name.encode():
            return _block(data, _handle(handle, 0)[0], True)
    return None


def table_get(data: bytes, key: bytes, seq: int, policy: FilterPolicy | None = BloomPolicy()) -> Row | None:
    """The newest record of ``key`` up to ``seq`` in a table, a tombstone too; None if there is none.

    The filter first, then the one block that the index names, searched from its restarts.
    """
    found = None if policy is None else table_filter(data, policy.name)
    if found is not None and not policy.may_hold(key, found):
        return None
    _, at = _handle(data, len(data) - FOOTER)
    index, _ = _handle(data, at)
    order = lambda k: (k[:-8], -struct.unpack("<Q", k[-8:])[0])
    target = (key, -(seq << 8 | 255))
    for last, handle in _entries(_block(data, index, True)):
        if order(last) >= target:
            for entry, value in block_seek(_block(data, _handle(handle, 0)[0], True), target):
                packed = struct.unpack("<Q", entry[-8:])[0]
                if entry[:-8] != key:
                    return None
                return key, packed >> 8, packed & 255, value if packed & 255 == PUT else None
    return None


def block_seek(contents: bytes, target: tuple[bytes, int]) -> Iterator[tuple[bytes, bytes]]:
    """The entries of a block from ``target``, a user key and a negated tag, on; by halves over the restarts."""
    count = struct.unpack_from("<I", contents, len(contents) - 4)[0]
    end = len(contents) - 4 * (count + 1)
    order = lambda k: (k[:-8], -struct.unpack("<Q", k[-8:])[0])
    restarts = struct.unpack_from(f"<{count}I", contents, end)
    low = bisect_left(restarts, True, key=lambda at: order(next(_entries(contents, at))[0]) >= target) if end else 0
    for key, value in _entries(contents, restarts[max(0, low - 1)]):
        if order(key) >= target:
            yield key, value


# manifest edits


def encoded_edit(comparator: str | None = None, log_number: int | None = None, last_sequence: int | None = None, new_files: list[dict] = (), deleted_files: list[int] = ()) -> bytes:
    """One edit. A new file is described by ``run_id, level, file_size``, its end keys and, for their tags, ``min_seq, max_seq``."""
    out = bytearray()
    if comparator is not None:
        out += b"\1" + length_prefixed(comparator.encode())
    if log_number is not None:
        out += b"\2" + varint(log_number)
    if last_sequence is not None:
        out += b"\5" + varint(last_sequence)
    for f in new_files:
        out += b"\3" + varint(f["run_id"]) + varint(f["file_size"])
        out += length_prefixed(f["smallest_key"] + fixed64(f.get("max_seq", 0) << 8 | PUT))
        out += length_prefixed(f["largest_key"] + fixed64(f.get("min_seq", 0) << 8 | PUT))
        if f.get("level", 0):
            out += b"\6" + varint(f["level"])
    for run_id in deleted_files:
        out += b"\4" + varint(run_id)
    return bytes(out)


def live_runs(manifest: bytes) -> dict[int, dict]:
    """The live tables of a manifest file by number, as its edits describe them."""
    live: dict[int, dict] = {}
    for payload in log_payloads(manifest):
        edit = edit_fields(payload)
        live |= {f["run_id"]: f for f in edit["new_files"]}
        for run_id in edit["deleted_files"]:
            live.pop(run_id, None)
    return live


def edit_fields(payload: bytes) -> dict:
    """``comparator, log_number, last_sequence, new_files, deleted_files`` of one edit; absent ones are None or empty."""
    found: dict = {"comparator": None, "log_number": None, "last_sequence": None, "new_files": [], "deleted_files": []}
    at = 0
    try:
        while at < len(payload):
            tag, at = payload[at], at + 1
            if tag == 1:
                name, at = read_length_prefixed(payload, at)
                found["comparator"] = name.decode()
            elif tag in (2, 5):
                found["log_number" if tag == 2 else "last_sequence"], at = read_varint(payload, at)
            elif tag == 3:
                number, at = read_varint(payload, at)
                size, at = read_varint(payload, at)
                low, at = read_length_prefixed(payload, at)
                high, at = read_length_prefixed(payload, at)
                found["new_files"].append({"run_id": number, "level": 0, "file_size": size, "smallest_key": low[:-8], "largest_key": high[:-8]})
            elif tag == 4:
                number, at = read_varint(payload, at)
                found["deleted_files"].append(number)
            elif tag == 6 and found["new_files"]:
                found["new_files"][-1]["level"], at = read_varint(payload, at)
            else:
                raise Corruption(f"unknown edit field {tag}")
    except ValueError as cut:
        raise Corruption(str(cut)) from cut
    return found


def live_tables(manifest: bytes) -> tuple[set[int], int, int]:
    """Numbers of the live tables, the current log's number and the last sequence, replayed from a manifest file."""
    live, log_number, last = set(), 0, 0
    for payload in log_payloads(manifest):
        edit = edit_fields(payload)
        live |= {f["run_id"] for f in edit["new_files"]}
        live -= set(edit["deleted_files"])
        log_number = log_number if edit["log_number"] is None else edit["log_number"]
        last = max(last, edit["last_sequence"] or 0)
    return live, log_number, last


# DataFrames


def _read(spark: SparkSession, paths: list[str], parse) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int8(), pa.binary()]
        for batch in batches:
            for n in range(batch.num_rows):
                rows: list[Row] = []
                for row in parse(batch.column(0)[n].as_py()):
                    rows.append(row)
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=LOG.names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=LOG.names)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, LOG)


def _packed(log: DataFrame, run: str, encode: Callable[[list[Row]], bytes]) -> DataFrame:
    """``run, content``: each run of ``log(user_key, seq, type, value)`` as one file's bytes. A run must fit into a task."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        listed = list(zip(*(rows.column(c).to_pylist() for c in LOG.names)))
        return pa.table({"run": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([encode(listed)], pa.binary())})

    return log.select(F.col(run).cast("long").alias("run"), *LOG.names).groupBy("run").applyInArrow(pack, "run long, content binary")


def _write(packed: DataFrame, folder: str, suffix: str, last: bytes) -> list[str]:
    """Write files that all end in the byte ``last``, where their rows lie; returns their paths, sorted by run.

    The line writer puts the bytes as they are, and its line separator behind them, which is the last byte. It
    names the files itself, in a folder for each run, so the driver renames them; their bytes don't pass through it.
    """
    from tidelog.sources.files import Files

    files, staging = Files(packed.sparkSession, folder), f"_staging-{uuid.uuid4().hex}"
    files.make_folder()
    there = set(files.names())
    trimmed = F.substr("content", F.lit(1), F.octet_length("content") - 1).cast("string").alias("value")
    writer = packed.select("run", trimmed).write.partitionBy("run").option("encoding", "ISO-8859-1").option("lineSep", last.decode("latin-1"))

    def named(run: int) -> str:
        (part,) = files.names(f"{staging}/run={run}")  # a run is one row
        files.rename(f"{staging}/run={run}/{part}", f"{run:06d}{suffix}")
        return f"{files.root}/{run:06d}{suffix}"

    try:
        writer.text(f"{files.root}/{staging}")
        runs = sorted(int(n.removeprefix("run=")) for n in files.names(staging) if n.startswith("run="))
        if taken := [n for n in (f"{run:06d}{suffix}" for run in runs) if n in there]:
            raise IOFailure(f"{folder} has {taken[0]} already")
        with ThreadPoolExecutor(RENAMES) as pool:
            return list(pool.map(named, runs))
    finally:
        files.delete(staging)


def write_tables(log: DataFrame, folder: str, run: str = "run_id", policy: FilterPolicy | None = BloomPolicy()) -> list[str]:
    """Write each run of ``log`` as a sorted table file into ``folder``; returns the paths."""
    return _write(_packed(log, run, lambda rows: encoded_table(rows, policy=policy)), folder, ".ldb", fixed64(MAGIC)[-1:])


def _batches(rows: list[Row]) -> list[bytes]:
    """Rows as batches of consecutive sequences."""
    ordered = sorted(rows, key=lambda r: r[1])
    cuts = [0, *(i for i in range(1, len(ordered)) if ordered[i][1] != ordered[i - 1][1] + 1), len(ordered)]
    return [encoded_batch(ordered[a:b]) for a, b in zip(cuts, cuts[1:])]


def write_logs(log: DataFrame, folder: str, run: str = "run_id") -> list[str]:
    """Write each run of ``log`` as a file of framed batches into ``folder``; returns the paths.

    A batch without operations, which ends in a zero, closes each file.
    """

    def encode(rows: list[Row]) -> bytes:
        closing = struct.pack("<QI", max(r[1] for r in rows) + 1, 0)
        return framed_log([*_batches(rows), closing])

    return _write(_packed(log, run, encode), folder, ".log", b"\0")


def read_tables(spark: SparkSession, *paths: str, verify: bool = True) -> DataFrame:
    """The log rows of table files, or of all in a folder, which takes no listing of paths one by one; each file is read in one task."""
    return _read(spark, list(paths), lambda data: table_rows(data, verify))


def read_logs(spark: SparkSession, *paths: str, verify: bool = True) -> DataFrame:
    """The log rows of batch logs, or of all in a folder; each file is read in one task."""
    return _read(spark, list(paths), lambda data: (row for payload in log_payloads(data, verify) for row in batch_rows(payload)))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """All live records of a store folder: the live tables of its ``MANIFEST`` and its current log."""
    from tidelog.sources.files import Files

    files = Files(spark, folder)
    live, log_number, _ = live_tables(files.read("MANIFEST")) if files.exists("MANIFEST") else (set(), 0, 0)
    tables = [f"{files.root}/{n:06d}.ldb" for n in sorted(live)]
    logs = [f"{files.root}/{n}" for n in files.names() if n.endswith(".log") and n[:-4].isdigit() and int(n[:-4]) >= log_number]
    frames = ([read_tables(spark, *tables)] if tables else []) + ([read_logs(spark, *logs)] if logs else [])
    if not frames:
        return spark.createDataFrame([], LOG)
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
