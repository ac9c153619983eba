"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph import storage
from loomgraph.llm import packing, tokenizer
from loomgraph.plans.tables import table


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    sizes = {r["size_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "container_sizes").collect()}  # 3 rows, fixed
    return packing.pack(tokenizer.count_tokens(table(spark, sf_dir, "documents")), sizes), sizes


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, sizes = _packed(spark, sf_dir)
    return packing.summary(storage.cut(packed, "packed"), sizes)


QUERIES = {"p7_containers": p7_containers, "p7_summary": p7_summary}
SQL: dict[str, str] = {}
