"""Rewriting ambiguous surface dictionaries (surface_id, entity, cnt): one column per stage, null for a deleted candidate.

A working table has columns surface_id, old_entity, cnt, entity. Rules read the values of one stage and write the next.
Where the best rival of a surface is needed it is aggregated and joined, so that hot surfaces are combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators.graph import TypeGraph

KEEP_MIN = 5


def start(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("surface_id", F.col("entity").alias("old_entity"), "cnt", "entity")


def flag(rows: DataFrame, members: DataFrame, name: str, column: str = "entity") -> DataFrame:
    """rows with a boolean column for membership; a deleted candidate belongs to no set."""
    m = members.select(F.col("entity").alias(column), F.lit(True).alias(name)).distinct()
    return rows.join(m, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def keep_high(old: Column, new: Column) -> Column:
    """Whether a candidate counted `new` may replace one counted `old`: it is higher, or above 50 and at least four fifths."""
    return (new > old) | ((new > 50) & (new >= 0.8 * old))


def promote(rows: DataFrame, condition: Column, alternative: Column, keep_min: int = KEEP_MIN) -> DataFrame:
    """Rows under the condition whose count is below that of their surface's best alternative become that entity.

    The best alternative has the highest count, ties go to the smaller entity. If its own count is at most keep_min, the row is deleted instead.
    """
    best = rows.where(alternative & F.col("entity").isNotNull()).groupBy("surface_id").agg(F.max(F.struct("cnt", (-F.col("entity")).alias("neg"))).alias("best"))
    out = rows.join(best, "surface_id", "left")
    hit = F.coalesce(condition & F.col("entity").isNotNull() & F.col("best").isNotNull() & (F.col("cnt") < F.col("best.cnt")), F.lit(False))
    value = F.when(F.col("best.cnt") > keep_min, -F.col("best.neg"))
    return out.withColumn("entity", F.when(hit, value).otherwise(F.col("entity"))).drop("best")


def extend(rows: DataFrame, alternative: Column, graph: TypeGraph, paths: list[tuple[list[tuple[str, int]], bool]], keep_min: int = KEEP_MIN) -> DataFrame:
    """Each row moves to the highest-counted alternative of its surface that its entity reaches by one of the typed paths.

    paths: (steps, promotes); where a path doesn't promote, the alternative must be high enough (keep_high). Deleted instead if the
    alternative counts at most keep_min. Reads old values only. Candidates are joined to what they reach, not to each other.
    """
    starts = storage.cut(rows.where("entity is not null").select("entity").distinct(), "starts")
    ends = rows.where(alternative & F.col("entity").isNotNull()).select("entity").distinct()
    reach = None
    for steps, promotes in relevant(paths, graph, ends):
        r = graph.path_reach(starts, steps).select(F.col("source").alias("entity"), F.col("entity").alias("other"), F.lit(promotes).alias("promotes"))
        reach = r if reach is None else reach.unionByName(r)
    if reach is None:
        return rows
    reach = reach.where("entity <> other").groupBy("entity", "other").agg(F.max("promotes").alias("promotes"))
    alt = rows.where(alternative & F.col("entity").isNotNull()).groupBy("surface_id", F.col("entity").alias("other")).agg(F.max("cnt").alias("other_cnt"))
    hits = rows.where("entity is not null").select("surface_id", "old_entity", "entity", "cnt").join(reach, "entity").join(alt, ["surface_id", "other"])
    hits = hits.where(F.col("promotes") | keep_high(F.col("cnt"), F.col("other_cnt")))
    best = hits.groupBy("surface_id", "old_entity").agg(F.max(F.struct("other_cnt", (-F.col("other")).alias("neg"))).alias("best"))
    out = rows.join(best, ["surface_id", "old_entity"], "left")
    value = F.when(F.col("best.other_cnt") > keep_min, -F.col("best.neg"))
    return out.withColumn("entity", F.when(F.col("best").isNotNull(), value).otherwise(F.col("entity"))).drop("best")


def relevant(paths: list, graph: TypeGraph, ends: DataFrame) -> list:
    """The paths that can lead to one of the ends (entity): all their relations have edges, and some end is a value of the last. Loses nothing."""
    have = {r["prop"] for r in graph.edges.select("prop").distinct().collect()}  # as many as there are properties
    lasts = sorted({steps[-1][0] for steps, _ in paths} & have)
    hit = graph.edges.where(F.col("prop").isin(lasts)).select("prop", F.col("parent").alias("entity")).join(ends, "entity", "left_semi").select("prop").distinct()
    reached = {r["prop"] for r in hit.collect()} if lasts else set()
    return [(steps, promotes) for steps, promotes in paths if steps[-1][0] in reached and all(r.partition(".")[0] in have for r, _ in steps)]


def drop(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.withColumn("entity", F.when(~F.coalesce(condition, F.lit(False)), F.col("entity")))


def unchanged() -> Column:
    return F.coalesce(F.col("entity") == F.col("old_entity"), F.lit(False))


def reduce_values(rows: DataFrame) -> DataFrame:
    """(surface_id, entity, cnt): deleted candidates gone, equal ones added up; surfaces without candidates disappear."""
    return rows.where("entity is not null").groupBy("surface_id", "entity").agg(F.sum("cnt").alias("cnt"))


def emptied(rows: DataFrame) -> DataFrame:
    """(surface_id): surfaces that no candidate is left of."""
    return rows.groupBy("surface_id").agg(F.count("entity").alias("n")).where("n = 0").select("surface_id")


def transitions(rows: DataFrame) -> DataFrame:
    return rows.select("surface_id", "old_entity", F.col("entity").alias("new_entity"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two passes' transitions as one; deleted stays deleted."""
    nxt = second.select("surface_id", F.col("old_entity").alias("new_entity"), F.col("new_entity").alias("last"))
    return first.join(nxt, ["surface_id", "new_entity"], "left").select("surface_id", "old_entity", F.col("last").alias("new_entity"))


def change_stats(rows: DataFrame) -> DataFrame:
    """(n_changed, changed_volume, n_deleted)."""
    moved = ~unchanged()
    return rows.agg(F.count_if(moved).alias("n_changed"), F.coalesce(F.sum(F.when(moved, F.col("cnt"))), F.lit(0)).cast("long").alias("changed_volume"), F.count_if(F.col("entity").isNull()).alias("n_deleted"))


def fix_pass(dictionary: DataFrame, graph: TypeGraph, masks: dict[str, DataFrame], lengths: DataFrame, paths: list) -> DataFrame:
    """One repair pass, as a working table. masks: aspect, people, history, episode, kin, protected, cardinal, country, political, short_lived,
    anchored (has any structural link); lengths (surface_id, length).

    Stages: aspect to people; unchanged history to what is no history; short surfaces and episodes deleted; candidates moved along
    typed paths to what is no person; unchanged ones without structural links deleted; people to kin; unprotected ones below
    100 to cardinal, country, political, each only if unchanged so far.
    """
    def stage(rows: DataFrame, *names: str) -> DataFrame:
        """The rows written once, as a stage reads them for itself and for its best alternatives; with flags for the named masks."""
        rows = storage.cut(rows.select("surface_id", "old_entity", "cnt", "entity", "length"), "stage")
        for n in names:
            rows = flag(rows, masks[n], n)
        return rows

    rows = start(dictionary).join(lengths, "surface_id", "left")
    rows = promote(stage(rows, "aspect", "people"), F.col("aspect"), F.col("people"))
    rows = promote(stage(rows, "history"), F.col("history") & unchanged(), ~F.col("history"))
    rows = flag(flag(rows, masks["short_lived"], "short_lived"), masks["episode"], "episode")
    rows = drop(rows, (F.col("length") < 2) | (F.col("short_lived") & (F.col("length") <= 2)) | F.col("episode"))
    rows = extend(stage(rows, "people"), ~F.col("people"), graph, paths)
    rows = drop(flag(rows, masks["anchored"], "anchored"), unchanged() & ~F.col("anchored"))
    rows = promote(stage(rows, "people", "kin"), F.col("people"), F.col("kin"))
    return promote_places(rows, masks).select("surface_id", "old_entity", "cnt", "entity")


def promote_places(rows: DataFrame, masks: dict[str, DataFrame]) -> DataFrame:
    """Rows in no protected class, below 100 and unchanged since the pass began: promoted to cardinal directions, then countries, then political bodies."""
    for name in ("cardinal", "country", "political"):
        rows = storage.cut(rows.select("surface_id", "old_entity", "cnt", "entity"), "stage")
        rows = flag(flag(rows, masks["protected"], "protected"), masks[name], name)
        rows = promote(rows, ~F.col("protected") & (F.col("cnt") < 100) & unchanged(), F.col(name))
    return rows


def iterate(dictionary: DataFrame, one_pass, steps: int = 3) -> tuple[DataFrame, DataFrame]:
    """(dictionary, transitions) after several passes. one_pass: dictionary to working table. Each pass is written, as the next reads it repeatedly."""
    total = None
    for _ in range(steps):
        rows = storage.cut(one_pass(dictionary), "repair")
        dictionary = storage.cut(reduce_values(rows), "dictionary")
        total = transitions(rows) if total is None else compose(total, transitions(rows))
    return dictionary, total
