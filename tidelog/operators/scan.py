"""Point, multi-key and ordered reads of what is visible at a snapshot.

Key predicates are applied to the log before the newest record is looked for, so that they reach the
Parquet scan; that is sound because they keep or drop all versions of a key together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import prefix_end
from tidelog.operators.mvcc import at, newest, visible, visible_keys
from tidelog.schema import PUT


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """``user_key, value`` of one key, no row if it is deleted or absent."""
    return visible(log.where(F.col("user_key") == F.lit(key)), snapshot)


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``user_key, state, value`` for each row of ``keys(user_key)``; state is ``value``, ``deleted`` or ``absent``.

    Only versions of asked keys are aggregated: a semi-join comes first, which Spark turns into a runtime
    filter or a broadcast where ``keys`` is small.
    """
    asked = at(log, snapshot).join(keys.select("user_key").distinct(), "user_key", "left_semi")
    found = newest(asked)
    state = F.when(F.col("type").isNull(), "absent").when(F.col("type") == PUT, "value").otherwise("deleted")
    joined = keys.select("user_key").join(found, "user_key", "left")
    return joined.select("user_key", state.alias("state"), F.when(F.col("type") == PUT, F.col("value")).alias("value"))


def contains(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The rows of ``keys(user_key)`` that are visible."""
    return keys.join(visible_keys(log, snapshot), "user_key", "left_semi")


def between(log: DataFrame, start=None, end=None, snapshot: int | None = None) -> DataFrame:
    """Visible keys in ``[start, end)``; None leaves a side open."""
    if start is not None:
        log = log.where(F.col("user_key") >= F.lit(start))
    if end is not None:
        log = log.where(F.col("user_key") < F.lit(end))
    return visible(log, snapshot)


def prefixed(log: DataFrame, prefix, snapshot: int | None = None) -> DataFrame:
    """Visible keys that start with ``prefix``: a range for bytes, ``startswith`` for strings; both reach the scan."""
    if isinstance(prefix, (bytes, bytearray)):
        return between(log, bytes(prefix), prefix_end(bytes(prefix)), snapshot)
    return visible(log.where(F.col("user_key").startswith(prefix)), snapshot)


def forward(rows: DataFrame, limit: int | None = None, order: Callable[[Column], Column] = lambda key: key) -> DataFrame:
    """``rows`` in key order, bytewise unless ``order`` says otherwise; with ``limit`` a top-k, not a full sort."""
    ordered = rows.orderBy(order(F.col("user_key")))
    return ordered if limit is None else ordered.limit(limit)


def backward(rows: DataFrame, limit: int | None = None, order: Callable[[Column], Column] = lambda key: key) -> DataFrame:
    """The mirror of ``forward``, over the same visible rows."""
    ordered = rows.orderBy(order(F.col("user_key")).desc())
    return ordered if limit is None else ordered.limit(limit)


def seek(log: DataFrame, target, limit: int | None = None, snapshot: int | None = None) -> DataFrame:
    """From the first visible key at or after ``target``; no rows past the end."""
    return forward(between(log, start=target, snapshot=snapshot), limit)


def next_page(log: DataFrame, after, limit: int, snapshot: int | None = None) -> DataFrame:
    """The ``limit`` visible keys that follow ``after``."""
    return forward(visible(log.where(F.col("user_key") > F.lit(after)), snapshot), limit)


def previous_page(log: DataFrame, before, limit: int, snapshot: int | None = None) -> DataFrame:
    """The ``limit`` visible keys before ``before``, descending."""
    return backward(visible(log.where(F.col("user_key") < F.lit(before)), snapshot), limit)


def first_last(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``first_key, last_key`` of the visible rows; nulls where there are none."""
    return visible_keys(log, snapshot).agg(F.min("user_key").alias("first_key"), F.max("user_key").alias("last_key"))


def around(log: DataFrame, target, snapshot: int | None = None) -> DataFrame:
    """``predecessor`` below ``target`` and ``successor`` at or above it."""
    key = F.col("user_key")
    return visible_keys(log, snapshot).agg(
        F.max(F.when(key < F.lit(target), key)).alias("predecessor"), F.min(F.when(key >= F.lit(target), key)).alias("successor")
    )
