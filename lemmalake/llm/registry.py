"""Collects the pN_ queries of the modules of this folder."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("top_per_group", "packing", "format_copies", "encoding", "similar", "cross_split", "leaks", "truncated", "garbled")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in importlib.import_module(f"lemmalake.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"lemmalake.llm.{m}").SQL.items()}
