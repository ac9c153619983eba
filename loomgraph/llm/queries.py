"""Queries and SQL of the problems tagged llm, from the modules of this folder."""

from __future__ import annotations

import importlib

MODULES = ("q3_top_n", "q4_sentences", "q6_tokens", "q7_packing", "q8_moderation")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"loomgraph.llm.{m}"), name))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
