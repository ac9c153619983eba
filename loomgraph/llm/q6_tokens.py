"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import tokenizer
from loomgraph.plans.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
