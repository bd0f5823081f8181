"""Folders for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and every executor can reach.

    It lies in ``spark.checkpoint.dir``. Only where that is unset and all runs in one process, as in tests,
    a temporary folder takes its place; on a cluster without the setting this is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _temporary()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(1)
def _temporary() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
