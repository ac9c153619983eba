"""Readers of the engine's input formats. Compressed files (bz2, gz) are read by their suffix, as Spark does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.functions import text as X
from loomgraph.operators import nested


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, json_line) of a dump. The number orders lines within a file part; it isn't dense, as no pass over the file is made to count."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("json_line"))


def entity_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a dump by its suffix: json or json.bz2 lines, or Parquet with line_no and json_line."""
    if path.rstrip("/").endswith((".json", ".jsonl", ".bz2", ".gz")):
        return nested.records(json_lines(spark, path))
    if path.rstrip("/").endswith(".parquet"):
        return nested.records(spark.read.parquet(path))
    raise ValueError(f"unknown format: {path}")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of a page dump in XML, without talk-like and file pages."""
    raw = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text: string>").load(path)
    hidden = " or ".join(f"startswith(title, '{t}')" for t in X.HIDDEN_TITLES)
    return raw.where(f"title is not null and not ({hidden})").select("title", F.col("revision.text").alias("text"))


def redirects(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of tab-separated lines; a field above 256 bytes drops its line, sources are capitalised, the last line of a source wins."""
    parts = F.split("value", "\t", 2)
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("k"), F.get(parts, F.lit(0)).alias("source"), F.get(parts, F.lit(1)).alias("target"))
    ok = raw.where("target is not null and octet_length(source) <= 256 and octet_length(target) <= 256")
    return ok.groupBy(X.clean_title(F.col("source")).alias("source")).agg(F.max_by("target", "k").alias("target"))


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """(context, anchor, target) of tab-separated lines; lines with fewer fields, or more than 256 bytes before or after the first tab, are skipped."""
    parts = F.split("value", "\t", 3)
    raw = spark.read.text(path).where(F.octet_length(F.substring_index("value", "\t", 1)) <= 256).select("value", parts.alias("p"))
    rest = F.octet_length("value") - F.octet_length(F.get("p", F.lit(0))) - 1
    return raw.where((F.size("p") == 3) & (rest <= 256)).select(F.get("p", F.lit(0)).alias("context"), F.get("p", F.lit(1)).alias("anchor"), F.get("p", F.lit(2)).alias("target"))


def names(spark: SparkSession, path: str, prefix: str, most: int) -> DataFrame:
    """(entity, name): titles of one wiki below an entity number, from lines prefix/title, tab, number."""
    parts = F.split("value", "\t", 2)
    raw = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("t"), F.try_to_number(F.get(parts, F.lit(1)), F.lit("999999999999")).cast("long").alias("entity"))
    return raw.where(F.col("t").startswith(prefix) & (F.col("entity") < most)).select("entity", F.expr(f"substring(t, {len(prefix) + 1})").alias("name"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, k, line): the lines of text files with their order: blocks of a file by their start, the lines of a block by k.

    A block is what one task reads, so that nothing is gathered to number lines.
    """
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line"))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def labelled_sequences(spark: SparkSession, path: str, comment: str = "#", ignore: str | None = None, token: int = 0, label: int = 1) -> DataFrame:
    """(seq, pos, token, label) of tab-separated lines; blank and comment lines end a sequence, the ignored label becomes null, sequences without labels go.

    token and label are column numbers; a line without the column has no label. Separators are counted in each block, blocks are summed up for each file:
    tasks hold a block, however long the file is.
    """
    lines = ordered_lines(spark, path)
    ends = (F.trim("line") == "") | F.startswith("line", F.lit(comment))
    lines = lines.withColumn("ends", ends.cast("int"))
    blocks = lines.groupBy("file", "block").agg(F.sum("ends").alias("n"))
    before = blocks.select("file", "block", (F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    own = F.sum("ends").over(W.partitionBy("file", "block").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("own", own).join(before, ["file", "block"]).where("ends = 0")
    parts = F.split("line", "\t")
    name = F.nullif(F.get(parts, F.lit(label)), F.lit(""))
    rows = rows.select(F.concat_ws("#", "file", (F.col("before") + F.col("own")).cast("string")).alias("seq"), "block", "k", F.get(parts, F.lit(token)).alias("token"), F.when(name != (ignore or ""), name).alias("label"))
    rows = rows.withColumn("pos", (F.row_number().over(W.partitionBy("seq").orderBy("block", "k")) - 1).cast("int"))
    return rows.withColumn("any", F.max("label").over(W.partitionBy("seq"))).where("any is not null").select("seq", "pos", "token", "label")


def relation(spark: SparkSession, path: str, prop: str) -> DataFrame:
    """(child, parent, pos) of one property of written relations; only its folder is read."""
    return spark.read.parquet(path).where(F.col("prop") == prop).select("child", "parent", "pos")


def attribute(spark: SparkSession, path: str, prop: str) -> DataFrame:
    """(entity, year) of one property of written dates (prop, entity, year, pos): the first of each entity."""
    return spark.read.parquet(path).where(F.col("prop") == prop).groupBy("entity").agg(F.min_by("year", "pos").alias("year"))


def page_entities(lines: DataFrame, column: str = "value") -> DataFrame:
    """(page_id, qid) of the tuples (id,'wikibase_item','Q...', in lines of a SQL dump."""
    hit = F.explode(F.regexp_extract_all(column, F.lit(r"\((\d+,'wikibase_item','Q\d+)',"), F.lit(1)))
    return lines.select(hit.alias("x")).select(F.split("x", ",")[0].cast("long").alias("page_id"), F.regexp_extract("x", r"(Q\d+)$", 1).alias("qid"))
