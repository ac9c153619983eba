"""Writing the engine's outputs as Parquet, text or JSON. What is there already is left as it is, unless asked otherwise."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.functions import text as X
from loomgraph.operators import nested


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a finished output is there: Spark marks it, so that one cut off in between doesn't count."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet", again: bool = False) -> bool:
    """Writes df; False if a finished output was there and `again` wasn't asked for. Rests of an unfinished one are replaced."""
    if not again and is_written(df.sparkSession, path):
        return False
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(path)
    return True


def compressed_dump(dump: DataFrame, path: str, again: bool = False) -> bool:
    """The leaves of a dump's records without labels, ranks, hashes and the like: what the engine reads, a fraction of the dump."""
    return write_table(nested.leaf_rows(nested.records(dump)), path, ("leaf_kind",), again=again)


def property_tables(dump: DataFrame, folder: str, props: list[str] | None = None, again: bool = False) -> list[str]:
    """ids, titles and claims of a dump by one parse: claims are partitioned by property, so that a relation is read alone. Names of what was written."""
    leaves = storage.cut(nested.leaf_rows(nested.records(dump)), "leaves")
    main = leaves.where("leaf_kind = 'main'").select("prop", "qid", F.col("claim_no").alias("pos"), F.col("leaf_text").alias("value"))
    titles = leaves.where("leaf_kind = 'sitelink'").select(F.concat_ws("/", "prop", "leaf_text").alias("wiki_title"), "qid")
    claims = main if props is None else main.where(F.col("prop").isin(list(props)))
    parts = {"titles": (titles, ()), "claims": (claims, ("prop",))}
    done = [n for n, (df, by) in parts.items() if write_table(df, f"{folder}/{n}", by, again=again)]
    storage.drop(leaves)
    return done


def relations(edges: DataFrame, path: str, again: bool = False) -> bool:
    """Edges (prop, child, parent, pos), a folder for each property; rows of a child stand together, which is what its offsets would say."""
    return write_table(edges.repartition("prop", "child").sortWithinPartitions("prop", "child", "pos"), path, ("prop",), again=again)


def classification(classes: DataFrame, folder: str, again: bool = False) -> list[str]:
    """members (entity, class_id) and labels (class_id, label) of an exported classification."""
    labels = classes.select("class_id", "label").distinct()
    return [n for n, df in (("members", classes.select("entity", "class_id")), ("labels", labels.coalesce(1))) if write_table(df, f"{folder}/{n}", again=again)]


def extractions(pages: DataFrame, folder: str, again: bool = False) -> list[str]:
    """anchors, redirects and categories of pages (title, doc) as tab-separated lines, by one parse. Line ends and tabs in fields become blanks."""
    flat = lambda c: F.regexp_replace(c, r"[\t\r\n]+", " ")
    parsed = storage.cut(pages.where("title is not null").select("title", X.anchors(F.col("doc")).alias("a"), X.redirect(F.col("doc")).alias("r"), X.categories(F.col("doc")).alias("c")), "parsed")
    articles = parsed.where("not contains(title, ':')")
    own = articles.select(*[F.col("title").alias(c) for c in ("context", "anchor", "target")])
    anchors = own.unionByName(articles.select(F.col("title").alias("context"), F.explode("a").alias("a")).select("context", "a.anchor", "a.target"))
    parts = {
        "anchors": anchors.select("context", "anchor", "target"), "redirects": parsed.where("r is not null").select("title", F.col("r").alias("target")),
        "categories": parsed.select("title", F.explode("c").alias("category")),
    }
    lines = {n: df.select(F.concat_ws("\t", *[flat(F.col(c)) for c in df.columns]).alias("value")) for n, df in parts.items()}
    done = [n for n, df in lines.items() if write_table(df, f"{folder}/{n}", fmt="text", again=again)]
    storage.drop(parsed)
    return done


def labelled_tokens(tokens: DataFrame, path: str, sequence: str, pos: str, columns: list[str], again: bool = False) -> bool:
    """Tokens as lines of tab-separated columns, a blank line after each sequence; a null column and those after it are left off.

    A sequence is one value, which its length bounds; different sequences stand in any order.
    """
    cells = F.array_join(F.array(*[F.regexp_replace(F.col(c), r"[\t\r\n]+", " ") for c in columns]), "\t")
    rows = tokens.select(F.col(sequence).alias("s"), F.struct(F.col(pos), cells.alias("line")).alias("x"))
    whole = rows.groupBy("s").agg(F.sort_array(F.collect_list("x")).alias("x")).select(F.concat(F.array_join(F.transform("x", lambda t: t["line"]), "\n"), F.lit("\n")).alias("value"))
    return write_table(whole, path, fmt="text", again=again)


def windows(examples: DataFrame, path: str, group: list[str], pos: str, columns: list[str], again: bool = False) -> bool:
    """Windows as one row each: the group's columns, and by column the array of its lines in order."""
    rows = examples.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(pos, *columns))).alias("x"))
    return write_table(rows.select(*group, *[F.col("x").getField(c).alias(c) for c in columns]), path, again=again)


def fixed_mapping(dictionary: DataFrame, transitions: DataFrame, contexts: DataFrame, folder: str, again: bool = False) -> list[str]:
    """What a repair leaves: dictionary, the transitions from the old one, and contexts."""
    parts = {"dictionary": dictionary, "transitions": transitions, "contexts": contexts}
    return [n for n, df in parts.items() if write_table(df, f"{folder}/{n}", again=again)]


def report(rows: DataFrame, path: str, again: bool = False) -> bool:
    """A small report as JSON lines in one file."""
    return write_table(rows.coalesce(1), path, fmt="json", again=again)


def local_file(path: str) -> bool:
    """Whether a file on the driver counts as present: it has more than 100 bytes."""
    p = Path(path)
    return p.is_file() and p.stat().st_size > 100
