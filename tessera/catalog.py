"""All registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import registry

FLAGSHIP = "rank_bm25"
MODULES = ("q_rank", "q_eval", "q_ops", "q_sampling", "q_cases", "q_corpora", "q_checks")

for _name in MODULES:
    importlib.import_module(f"tessera.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
