"""All core queries and their SQL, from the modules of this folder."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("problems", "graph_queries", "mention_queries", "text_queries", "link_queries", "rule_queries")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(importlib.import_module(f"loomgraph.plans.{m}"), name)
        if twice := out.keys() & part.keys():
            raise ValueError(f"names given twice: {sorted(twice)}")
        out.update(part)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
