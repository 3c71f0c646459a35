"""The queries of the corpus operators, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with ``QUERIES`` (name -> function) and perhaps ``ORACLE`` (name -> DuckDB SQL).
MODULES = ("q01_pii", "q02_chat", "q03_line_dedup", "q04_toxicity", "q05_licenses", "q06_line_quality", "q07_ranking", "q08_bpe", "q09_simhash", "q10_decontaminate", "q11_filter_audit", "q12_packing", "q13_hard_negatives")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), "ORACLE", {}).items()}
