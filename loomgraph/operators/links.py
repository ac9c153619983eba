"""From links in pages to counted surfaces and mentions: resolving titles, cleaning surfaces, counting, and looking candidates up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators.mentions import apply_transitions

#: Bytes of a line before its first tab, and from there to its end, both tabs and the line end included.
FIELD_BYTES = 256


def resolve(asked: DataFrame, titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """(wiki, target, entity) of distinct (wiki, target): the title itself, else cleaned, else one redirect away and cleaned again, else -1.

    titles (wiki, title, entity), redirects (wiki, source, target). A second redirect isn't followed.
    """
    asked = asked.select("wiki", "target").distinct().withColumn("clean", X.clean_title(F.col("target")))
    named = lambda name, key: titles.select("wiki", F.col("title").alias(key), F.col("entity").alias(name))
    hop = redirects.select("wiki", F.col("source").alias("clean"), X.clean_title(F.col("target")).alias("hop"))
    got = asked.join(named("x", "target"), ["wiki", "target"], "left").join(named("y", "clean"), ["wiki", "clean"], "left")
    got = got.join(hop, ["wiki", "clean"], "left").join(named("z", "hop"), ["wiki", "hop"], "left")
    return got.select("wiki", "target", F.coalesce("x", "y", "z", F.lit(-1)).cast("long").alias("entity"))


def fits(context: str, anchor: str, target: str):
    """Whether a line of these three fields is short enough to be counted."""
    return (F.octet_length(context) <= FIELD_BYTES) & (F.octet_length(anchor) + F.octet_length(target) + 2 <= FIELD_BYTES)


def resolved_lines(lines: DataFrame, titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """(wiki, surface, entity, context) of anchor lines (wiki, context, anchor, target): cleaned surface, entity of the target and of the page; -1 if unknown.

    Equal lines are counted as n first, so that a hot title is resolved and joined back once for each different line.
    """
    lines = lines.where(fits("context", "anchor", "target")).groupBy("wiki", "context", "anchor", "target").agg(F.count("*").alias("n"))
    asked = lines.select("wiki", "target").unionByName(lines.select("wiki", F.col("context").alias("target")))
    known = resolve(asked, titles, redirects).where("entity >= 0")
    out = lines.join(known, ["wiki", "target"], "left")
    out = out.join(known.select("wiki", F.col("target").alias("context"), F.col("entity").alias("page")), ["wiki", "context"], "left")
    return out.select("wiki", "target", X.clean_surface(F.col("anchor")).alias("surface"), F.coalesce("entity", F.lit(-1)).alias("entity"), F.coalesce("page", F.lit(-1)).alias("context"), "n")


def surface_counts(resolved: DataFrame, by: str = "entity") -> DataFrame:
    """(surface, entity, n): how often each cleaned surface links to each entity, or with by = context stands in each page (-1 for an unknown page)."""
    ok = resolved.where("entity >= 0 and surface <> ''")
    return ok.groupBy("surface", F.col(by).alias("entity")).agg(F.sum("n").alias("n"))


def vocabulary(resolved: DataFrame) -> DataFrame:
    """(surface): cleaned surfaces with a link that resolves."""
    return resolved.where("entity >= 0 and surface <> ''").select("surface").distinct()


def diagnostics(resolved: DataFrame, samples: int = 10) -> DataFrame:
    """One row: links, those whose target is unknown, those whose surface is unusable, and the first unknown targets by name."""
    total = resolved.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.sum(F.when(F.col("entity") < 0, F.col("n"))), F.lit(0)).cast("long").alias("missing"),
        F.coalesce(F.sum(F.when(F.col("surface") == "", F.col("n"))), F.lit(0)).cast("long").alias("unusable"),
    )
    some = resolved.where("entity < 0").select("wiki", "target").distinct().orderBy("wiki", "target").limit(samples).collect()  # the report's samples
    return total.withColumn("samples", F.lit(" | ".join(sorted(f"{r['wiki']}/{r['target']}" for r in some))))


def obtain_tags(links: DataFrame, dictionary: DataFrame, transitions: DataFrame | None = None, repaired: DataFrame | None = None, min_count: int = 0, min_percent: float = 0.0, blacklist: DataFrame | None = None) -> DataFrame:
    """links (doc, pos, surface, entity) with the tag each is: entity, n_candidates, cnt; a null entity where it is none.

    A link is a tag if its cleaned surface is acceptable, in the dictionary (surface, entity, cnt) and not in the blacklist (surface), and its entity, moved
    by the transitions (surface, old_entity, entity) if given, is one of the candidates left in `repaired`. With min_count or min_percent the
    true candidate must have so many counts, and that share of its surface's.
    """
    now = dictionary if repaired is None else repaired
    if transitions is not None:
        asked = links.where("entity >= 0 and surface <> ''").select(F.col("surface").alias("surface_id"), "entity", F.lit(1).alias("n")).distinct()
        moved = apply_transitions(asked, transitions.select(F.col("surface").alias("surface_id"), "old_entity", F.col("entity").alias("new_entity")), now.select(F.col("surface").alias("surface_id"), "entity"))
        links = links.join(moved.select(F.col("surface_id").alias("surface"), F.col("old_entity").alias("entity"), F.col("entity").alias("moved")), ["surface", "entity"], "left").withColumn("entity", F.coalesce("moved", F.lit(-1))).drop("moved")
    if blacklist is not None:
        now = now.join(blacklist.select("surface").distinct(), "surface", "left_anti")
    total = now.groupBy("surface").agg(F.count("*").alias("n_candidates"), F.sum("cnt").alias("total"))
    ok = now.where(X.acceptable_surface(F.col("surface"))).join(total, "surface")
    if min_count > 0 or min_percent > 0:
        ok = ok.where((F.col("cnt") >= min_count) & (100.0 * F.col("cnt") / F.col("total") >= min_percent))
    got = links.join(ok.select("surface", "entity", "n_candidates", "cnt", F.col("entity").alias("tag")), ["surface", "entity"], "left")
    return got.select("doc", "pos", "surface", F.col("tag").alias("entity"), "n_candidates", "cnt")
