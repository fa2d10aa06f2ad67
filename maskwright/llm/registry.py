"""All queries and oracles of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("quality_rules", "quality_qda", "jaccard_join", "sharding", "secret_scan", "chat", "html_text", "packing", "url_graph", "decontaminate")


def _modules() -> list:
    return [import_module(f"maskwright.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLES", {}).items()}
