"""The engine's model tables, made from the test tables, in Spark and as common table expressions for the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import nested
from loomgraph.operators.heavy_keys import distinct_slots
from loomgraph.plans.problems import _RECORDS
from loomgraph.plans.tables import table


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, qid), each once."""
    both = [table(spark, sf_dir, t).select(F.col("entity").cast("long"), "qid") for t in ("entity_ids", "core_entities")]
    return both[0].unionByName(both[1]).distinct()


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.leaf_rows(nested.records(table(spark, sf_dir, "entity_dump")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prop, child, parent, pos): claims whose value is a known entity; unknown ids are dropped, order is kept in pos."""
    ids = entities(spark, sf_dir)
    main = leaves(spark, sf_dir).where("leaf_kind = 'main'").select("prop", "qid", F.col("leaf_text").alias("target"), F.col("claim_no").alias("pos"))
    child = ids.select("qid", F.col("entity").alias("child"))
    parent = ids.select(F.col("qid").alias("target"), F.col("entity").alias("parent"))
    return main.join(child, "qid").join(parent, "target").select("prop", "child", "parent", "pos")


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prop, entity, year, pos) of claims whose value is a time."""
    main = leaves(spark, sf_dir).where("leaf_kind = 'main'").select("prop", "qid", X.parse_year(F.col("leaf_text")).alias("year"), F.col("claim_no").alias("pos"))
    return main.where("year is not null").join(entities(spark, sf_dir), "qid").select("prop", "entity", "year", "pos")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, wiki, title, article_qid, doc): each article once."""
    return table(spark, sf_dir, "articles").select("article_id", "wiki", "title", "article_qid", "doc").dropDuplicates(["article_id"])


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wiki, title, entity): of several entities of one title the smallest."""
    site = leaves(spark, sf_dir).where("leaf_kind = 'sitelink'").select("qid", F.col("prop").alias("wiki"), F.col("leaf_text").alias("title"))
    own = pages(spark, sf_dir).where("article_qid is not null and title is not null").select(F.col("article_qid").alias("qid"), "wiki", "title")
    return site.unionByName(own).join(entities(spark, sf_dir), "qid").groupBy("wiki", "title").agg(F.min("entity").alias("entity"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface_id, entity, cnt): the surface dictionary, slots taken once; no deleted, null or uncounted candidates."""
    slots = distinct_slots(table(spark, sf_dir, "surface_dictionary")).where("entity >= 0 and cnt is not null")
    return slots.groupBy(F.col("trie_index").alias("surface_id"), "entity").agg(F.sum("cnt").alias("cnt"))


ENTITIES = "entities AS MATERIALIZED (SELECT CAST(entity AS BIGINT) AS entity, qid FROM entity_ids UNION SELECT entity, qid FROM core_entities)"
EDGES = f"""{_RECORDS}, {ENTITIES},
edges AS MATERIALIZED (SELECT l.prop, a.entity AS child, b.entity AS parent, l.claim_no AS pos FROM leaves l JOIN entities a ON a.qid = l.qid JOIN entities b ON b.qid = l.leaf_text WHERE leaf_kind = 'main')"""
YEAR = r"TRY_CAST(nullif(regexp_extract(leaf_text, '^([+-]?\d+)-', 1), '') AS INTEGER)"
DATES = f"dates AS MATERIALIZED (SELECT prop, entity, {YEAR} AS year, claim_no AS pos FROM leaves JOIN entities USING (qid) WHERE leaf_kind = 'main' AND {YEAR} IS NOT NULL)"
PAGES = "pages AS MATERIALIZED (SELECT article_id, any_value(wiki) AS wiki, any_value(title) AS title, any_value(article_qid) AS article_qid, any_value(doc) AS doc FROM articles GROUP BY article_id)"
TITLES = f"""{_RECORDS}, {ENTITIES}, {PAGES},
titles AS MATERIALIZED (SELECT wiki, title, min(entity) AS entity FROM (SELECT qid, prop AS wiki, leaf_text AS title FROM leaves WHERE leaf_kind = 'sitelink'
    UNION ALL SELECT article_qid, wiki, title FROM pages WHERE article_qid IS NOT NULL AND title IS NOT NULL) JOIN entities USING (qid) GROUP BY ALL)"""
DICTIONARY = """slots AS (SELECT slot_id, any_value(trie_index) AS surface_id, CAST(any_value(trie_index2indices_values) AS BIGINT) AS entity, any_value(trie_index2indices_counts) AS cnt
    FROM surface_dictionary GROUP BY slot_id),
dictionary AS MATERIALIZED (SELECT surface_id, entity, CAST(sum(cnt) AS BIGINT) AS cnt FROM slots WHERE entity >= 0 AND cnt IS NOT NULL GROUP BY ALL)"""
