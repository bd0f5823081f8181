"""Change streams: the log as a stream, applied to a store or folded into the latest state of each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.schema import LOG
from tidelog.store import VersionedStore


def read(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """A stream of the log records in Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", max_files).parquet(folder)


def apply_to(store: VersionedStore, ops: DataFrame, checkpoint: str, *order: str) -> StreamingQuery:
    """Commit each micro-batch of ``ops(user_key, type, value, ...)`` as one write in ``order``, exactly once.

    The commit names the stream, by its checkpoint, and the batch, so a batch that is tried again after it was
    written is left out.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.write_frame(batch, *order, stream=(checkpoint, number))

    return ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(log: DataFrame) -> DataFrame:
    """A stream of ``user_key, seq, type, value``: the newest record of a key, each time it changes.

    Records may come late and out of order; an older one changes nothing.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = held
        for part in parts:
            row = part.loc[part["seq"].idxmax()]
            if best is None or row["seq"] > best[0]:
                best = (int(row["seq"]), int(row["type"]), row["value"])
        if best != held:
            state.update(best)
            yield pd.DataFrame({"user_key": [key[0]], "seq": [best[0]], "type": [best[1]], "value": [best[2]]})

    return log.groupBy("user_key").applyInPandasWithState(fold, LOG, "seq long, type byte, value binary", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Run all that is there through ``sink`` and stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
