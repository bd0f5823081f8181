"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name to module; the module has ``query(spark, sf_dir)`` and may have ``ORACLE_SQL``.
MODULES = {
    "op1_license_scan": "license_scan",
    "op2_bradley_terry_quality": "quality",
    "op3_simhash_near_dedup": "simhash",
    "op4_composite_text_density": "html_text",
    "op5_benchmark_decontamination": "decontaminate",
    "op6_chat_token_assembly": "chat",
    "op7_entropy_mixing": "mixing",
    "op8_toxicity_gru": "toxicity",
    "op9_token_records": "records",
    "op10_media_fingerprints": "media",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"tidelog.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tidelog.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
