import bz2
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import readers as R
from loomgraph.streaming.counts import slot_counts


def test_json_lines(spark, tmp_path):
    lines = "[\n" + json.dumps({"id": "Q1", "lastrevid": 1}) + ",\n" + json.dumps({"id": "Q2", "lastrevid": 1}) + "\n]\n"
    p = tmp_path / "d.json.bz2"
    p.write_bytes(bz2.compress(lines.encode()))
    assert {r["qid"] for r in R.entity_records(spark, str(p)).collect()} == {"Q1", "Q2"}
    with pytest.raises(ValueError):
        R.entity_records(spark, "x.mp")


def test_pages_and_tables(spark, tmp_path):
    p = tmp_path / "p.xml"
    p.write_text("<m><page><title>A</title><revision><text>x [[B]]</text></revision></page><page><title>User:C</title><revision><text>y</text></revision></page></m>")
    assert [tuple(r) for r in R.pages(spark, str(p)).collect()] == [("A", "x [[B]]")]
    t = tmp_path / "r.tsv"
    t.write_text("a\tB\na\tC\n" + "z" * 300 + "\tD\nalone\n")
    assert [tuple(r) for r in R.redirects(spark, str(t)).collect()] == [("A", "C")]
    t.write_text("c\ta\tb\nc\ta\nc\t" + "x" * 300 + "\tb\n")
    assert [tuple(r) for r in R.anchors(spark, str(t)).collect()] == [("c", "a", "b")]
    t.write_text("enwiki/A b\t3\nenwiki/Z\t99\ndewiki/A\t2\n")
    assert [tuple(r) for r in R.names(spark, str(t), "enwiki/", 50).collect()] == [(3, "A b")]
    t.write_text("# c\nthe\ncat\tcat\n\nno\nlabels\n\ndog\tdog\n")
    got = R.labelled_sequences(spark, str(t))
    assert got.select("seq").distinct().count() == 2 and [(r["token"], r["label"]) for r in got.orderBy("seq", "pos").collect()] == [("the", None), ("cat", "cat"), ("dog", "dog")]
    dump = spark.createDataFrame([("INSERT (12,'wikibase_item','Q42',NULL),(13,'other','Q1',NULL),(14,'wikibase_item','Q7',NULL)",)], "value string")
    assert {tuple(r) for r in R.page_entities(dump).collect()} == {(12, "Q42"), (14, "Q7")}


def test_stream_equals_table(spark, tmp_path, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/surface_dictionary.parquet")
    (tmp_path / "in").mkdir()
    source.orderBy("counted_at").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = slot_counts(stream, late="3650 days").writeStream.format("memory").queryName("slots").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    total = lambda d: d.agg(F.sum("n"), F.sum("cnt")).first()
    assert tuple(total(spark.table("slots"))) == tuple(total(slot_counts(source)))
