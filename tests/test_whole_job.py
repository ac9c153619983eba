"""Queries that must not stop short of their input. The SQL has no bounds either; how many rows there must be is told apart from it."""

import pytest
from pyspark.sql import functions as F

import oracle_check
from loomgraph.functions import text as X
from loomgraph.plans import registry


@pytest.fixture(scope="module")
def wider():
    """Tables large enough to go beyond the bounds that the queries once had."""
    return "/root/testdata/sf0.01"


def test_known_names_of_all_ids(spark, wider):
    said = oracle_check.compare(spark, oracle_check.connect(wider), "known_names", wider, registry.queries()["known_names"], registry.oracle_sql()["known_names"])
    assert said.startswith("ok 383 rows"), said


def test_clean_markup_of_any_line_ends(spark, wider):
    assert [r[0] for r in spark.createDataFrame([("== A ==\r\nb\tc\r* d",)], "x string").select(X.clean_markup(F.col("x"))).collect()] == ["\n\nA. \nb c\n* d"]
    said = oracle_check.compare(spark, oracle_check.connect(wider), "clean_markup", wider, registry.queries()["clean_markup"], registry.oracle_sql()["clean_markup"])
    assert said.startswith("ok 598 rows"), said


def test_tokens_of_all_scripts(spark):
    got = [r[0] for r in spark.createDataFrame([("L'Été à 12 km.",), ("Жизнь, ١٢",), ("สวัสดี ครับ",), ("مُحَمَّد",)], "x string").select(X.tokens(F.col("x"))).collect()]
    assert got == [["L'Été", "à", "12", "km", "."], ["Жизнь", ",", "١٢"], ["สวัสดี", "ครับ"], ["مُحَمَّد"]]
    assert [r[0] for r in spark.createDataFrame([("Été",), ("жизнь",), ("Ж",), ("1A",)], "x string").select(X.uppercase(F.col("x"))).collect()] == [True, False, True, False]


def test_connections_of_any_length(spark, wider):
    said = oracle_check.compare(spark, oracle_check.connect(wider), "connection_path", wider, registry.queries()["connection_path"], registry.oracle_sql()["connection_path"])
    assert said.startswith("ok 316 rows"), said


def test_batches_of_all_wikis(spark, sf_dir):
    packed = registry.queries()["batch_packing"](spark, sf_dir)
    tokenized = registry.queries()["tokenize_text"](spark, sf_dir).select("article_id").distinct()
    assert packed.count() == tokenized.count() > 50
