"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import moderation
from loomgraph.plans.tables import table


def _scored(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return moderation.score(docs, moderation.train(docs, table(spark, sf_dir, "moderation_labels")), *keep)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("offensive").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "source")


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.by_source(_scored(spark, sf_dir, "source"))


def p8_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision on labelled documents that the model wasn't fitted on, with and without pairs of terms."""
    return moderation.held_out_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_source_rates": p8_source_rates, "p8_held_out": p8_held_out}
SQL: dict[str, str] = {}
