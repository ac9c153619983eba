"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import sentences
from loomgraph.plans.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wiki names the language of an article's wiki and is never null, unlike lang."""
    return sentences.sentence_units(table(spark, sf_dir, "articles"), "article_id", "doc", "wiki")


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
