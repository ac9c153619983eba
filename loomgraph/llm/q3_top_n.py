"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import top_n
from loomgraph.operators.heavy_keys import distinct_slots
from loomgraph.plans.tables import table


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trie_index, entity, score): counts summed over slots taken once. Map-side sums come first, so that no surface is hot."""
    slots = distinct_slots(table(spark, sf_dir, "surface_dictionary")).where("entity >= 0 and cnt is not null")
    return slots.groupBy("trie_index", "entity").agg(F.sum("cnt").alias("score"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n.top_n(_sums(spark, sf_dir), ["trie_index"], "score", "entity", 3).select("trie_index", "rank_no", "entity")


def p3_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n.top_n(_sums(spark, sf_dir), ["trie_index"], "score", "entity", 10)


_SQL = """WITH slots AS (SELECT slot_id, any_value(trie_index) AS trie_index, CAST(any_value(trie_index2indices_values) AS BIGINT) AS entity,
    any_value(trie_index2indices_counts) AS cnt FROM surface_dictionary GROUP BY slot_id),
sums AS (SELECT trie_index, entity, CAST(sum(cnt) AS BIGINT) AS score FROM slots WHERE entity >= 0 AND cnt IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trie_index ORDER BY score DESC, entity) AS rank_no FROM sums)
"""
QUERIES = {"p3_found": p3_found, "p3_top_scores": p3_top_scores}
SQL = {
    "p3_found": _SQL + "SELECT trie_index, rank_no, entity FROM ranked WHERE rank_no <= 3",
    "p3_top_scores": _SQL + "SELECT trie_index, rank_no, entity, score FROM ranked WHERE rank_no <= 10",
}
