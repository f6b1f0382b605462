"""Queries of the corpus operators, for the registry: one per operator, on whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_minhash_near_dedup": "minhash_dedup",
    "op3_url_filters": "url_filters",
    "op4_decontamination": "decontamination",
    "op5_token_counts": "token_counts",
    "op6_warc_bundles": "warc_bundles",
    "op7_source_mixing": "source_mixing",
    "op8_suffix_array_dedup": "suffix_dedup",
    "op9_lossless_webp": "lossless_webp",
    "op10_language_id": "language_id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"loomdex.llm.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"loomdex.llm.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
