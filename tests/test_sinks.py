import json
import warnings

import pytest

from loomgraph.sinks import writers as W
from loomgraph.sources import config, readers as R


def test_what_is_written_is_left(spark, tmp_path):
    p = f"{tmp_path}/t"
    a, b = (spark.createDataFrame([(k,)], "k long") for k in (1, 2))
    assert W.write_table(a, p) and not W.write_table(b, p) and spark.read.parquet(p).first()["k"] == 1
    assert W.write_table(b, p, again=True) and spark.read.parquet(p).first()["k"] == 2
    (tmp_path / "t" / "_SUCCESS").unlink()  # cut off in between
    assert W.write_table(a, p) and spark.read.parquet(p).first()["k"] == 1
    small, large = tmp_path / "s", tmp_path / "l"
    small.write_text("x"), large.write_text("x" * 101)
    assert not W.local_file(str(small)) and W.local_file(str(large)) and not W.local_file(f"{tmp_path}/none")


def test_relations_and_attributes(spark, tmp_path):
    rows = [("P31", 1, 5, 0), ("P31", 1, 6, 1), ("P279", 2, 5, 0)]
    edges = spark.createDataFrame(rows, "prop string, child long, parent long, pos int")
    W.relations(edges, f"{tmp_path}/e")
    assert sorted(tuple(r) for r in R.relation(spark, f"{tmp_path}/e", "P31").collect()) == [(1, 5, 0), (1, 6, 1)]
    W.write_table(spark.createDataFrame([("P569", 1, 1900, 1), ("P569", 1, 1899, 0), ("P570", 1, 1950, 0)], "prop string, entity long, year int, pos int"), f"{tmp_path}/d", ("prop",))
    assert [tuple(r) for r in R.attribute(spark, f"{tmp_path}/d", "P569").collect()] == [(1, 1899)]


def test_dump_outputs(spark, tmp_path):
    claim = {"mainsnak": {"datavalue": {"value": {"id": "Q2"}}}, "rank": "normal"}
    record = {"id": "Q1", "lastrevid": 3, "labels": {"en": "x"}, "claims": {"P31": [claim], "P279": [claim, claim]}, "sitelinks": {"enwiki": {"title": "A b"}}}
    dump = spark.createDataFrame([(0, json.dumps(record) + ",", None)], "line_no long, json_line string, dumped_at timestamp")
    assert W.property_tables(dump, f"{tmp_path}/p") == ["titles", "claims"] and W.property_tables(dump, f"{tmp_path}/p") == []
    claims = spark.read.parquet(f"{tmp_path}/p/claims")
    assert sorted((r["prop"], r["qid"], r["pos"], r["value"]) for r in claims.collect()) == [("P279", "Q1", 0, "Q2"), ("P279", "Q1", 1, "Q2"), ("P31", "Q1", 0, "Q2")]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/p/titles").collect()] == [("enwiki/A b", "Q1")]
    assert W.compressed_dump(dump, f"{tmp_path}/c") and spark.read.parquet(f"{tmp_path}/c").count() == 4


def test_extractions_come_back(spark, tmp_path):
    pages = spark.createDataFrame([("A", "x [[B#s|b\tc]] [[Category:K|z]]"), ("R", "#REDIRECT [[A]]"), ("T:x", "[[B]]")], "title string, doc string")
    assert W.extractions(pages, f"{tmp_path}/x") == ["anchors", "redirects", "categories"]
    assert sorted(tuple(r) for r in R.anchors(spark, f"{tmp_path}/x/anchors").collect()) == [("A", "A", "A"), ("A", "b c", "B"), ("R", "A", "A"), ("R", "R", "R")]
    assert [tuple(r) for r in R.redirects(spark, f"{tmp_path}/x/redirects").collect()] == [("R", "A")]
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/x/categories").collect()] == ["A\tCategory:K"]


def test_tokens_windows_mapping_reports(spark, tmp_path):
    rows = [("s", k, t, y) for k, (t, y) in enumerate([("the", None), ("cat", "cat"), ("a\nb", None)])] + [("u", 0, "none", None)]
    tokens = spark.createDataFrame(rows, "seq string, pos int, token string, label string")
    W.labelled_tokens(tokens, f"{tmp_path}/t", "seq", "pos", ["token", "label"])
    got = R.labelled_sequences(spark, f"{tmp_path}/t").orderBy("pos").collect()
    assert [(r["pos"], r["token"], r["label"]) for r in got] == [(0, "the", None), (1, "cat", "cat"), (2, "a b", None)]
    assert R.line_count(spark, f"{tmp_path}/t") == 6
    W.windows(tokens.where("seq = 's'"), f"{tmp_path}/w", ["seq"], "pos", ["token", "label"])
    assert spark.read.parquet(f"{tmp_path}/w").first()["label"] == [None, "cat", None]
    classes = spark.createDataFrame([(1, 0, "a"), (2, 1, "other")], "entity long, class_id int, label string")
    assert W.classification(classes, f"{tmp_path}/k") == ["members", "labels"] and spark.read.parquet(f"{tmp_path}/k/labels").count() == 2
    assert W.fixed_mapping(classes, classes, classes, f"{tmp_path}/m") == ["dictionary", "transitions", "contexts"]
    W.report(classes, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").where("label = 'a'").first()["entity"] == 1


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_sequences_over_blocks_of_a_file(spark, tmp_path, block):
    """A file that several tasks read gives the same sequences as one."""
    lines = []
    for k in range(60):
        lines += [f"w{k}a\tL", f"w{k}b", "" if k % 7 else "# note"]
    (tmp_path / "t.tsv").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = R.labelled_sequences(spark, f"{tmp_path}/t.tsv").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by = {}
    for r in rows:
        by.setdefault(r["seq"], []).append((r["pos"], r["token"], r["label"]))
    assert sorted(sorted(x) for x in by.values()) == sorted([(0, f"w{k}a", "L"), (1, f"w{k}b", None)] for k in range(60))
    dense = tmp_path / "d.tsv"
    dense.write_text("# text\n1\tLe\tle\tDET\n2\tchat\tchat\tNOUN\n\n")
    assert [(r["token"], r["label"]) for r in R.labelled_sequences(spark, str(dense), token=1, label=3).orderBy("pos").collect()] == [("Le", "DET"), ("chat", "NOUN")]
    assert [r["label"] for r in R.labelled_sequences(spark, str(dense), token=1, label=3, ignore="DET").orderBy("pos").collect()] == [None, "NOUN"]


def test_configurations(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"wiki": "x.xml", "paths": ["a", "b"], "inner": {"n": 1}}))
    c = config.load_config(f"{tmp_path}/c.json", relative=("wiki", "paths"), defaults={"size": 5})
    assert (c.wiki, c.paths, c.inner.n, c.size) == (f"{tmp_path}/x.xml", [f"{tmp_path}/a", f"{tmp_path}/b"], 1, 5)
    assert config.wiki_prefix("simplewiki-latest") == "simplewiki" and config.wiki_prefix("zhwiki") == "zhwiki"
    with pytest.raises(ValueError):
        config.wiki_prefix("/data/enwiki")
    (tmp_path / "b.json").write_text(json.dumps({"bad_node": ["Q1", "Q404"], "bad_node_pair": [["Q2", "Q1"], ["Q2", "Q405"]]}))
    ids = spark.createDataFrame([(10, "Q1"), (20, "Q2")], "entity long, qid string")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        nodes, pairs = config.load_blacklist(f"{tmp_path}/b.json", ids)
    assert "2 unknown ids" in str(said[-1].message)
    assert [tuple(r) for r in nodes.collect()] == [(10,)] and [tuple(r) for r in pairs.collect()] == [(20, 10)]
