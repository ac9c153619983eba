"""Predicates over entities, boolean algebra of sets, and classifications exported from named sets.

A set is a DataFrame (entity) without repeats. Sets stay sparse: their size follows the members, not all entities.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators.graph import Rule, TypeGraph
from loomgraph.operators.ranks import top_k

COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b}


def compare(value: Column, op: str, bound: int) -> Column:
    """A comparison that is false, not null, where the value is missing; its negation is then true."""
    return F.coalesce(COMPARE[op](value, F.lit(bound)), F.lit(False))


def any_of(*sets: DataFrame) -> DataFrame:
    if not sets:
        raise ValueError("a union needs at least one set")
    return reduce(lambda a, b: a.unionByName(b), [s.select("entity") for s in sets]).distinct()


def all_of(*sets: DataFrame) -> DataFrame:
    if not sets:
        raise ValueError("an intersection needs at least one set")
    return reduce(lambda a, b: a.join(b.select("entity"), "entity", "left_semi"), [s.select("entity") for s in sets]).distinct()


def none_of(truth: DataFrame, *falses: DataFrame) -> DataFrame:
    """truth without any of the others."""
    return reduce(lambda a, b: a.join(b.select("entity"), "entity", "left_anti"), falses, truth.select("entity").distinct())


def other(entities: DataFrame, *sets: DataFrame) -> DataFrame | None:
    """Those in none of the sets; None if there are no sets."""
    return none_of(entities, any_of(*sets)) if sets else None


def export(entities: DataFrame, classes: dict[str, DataFrame]) -> DataFrame:
    """(entity, class_id int, label): class ids are the places of the sorted names; of several the highest; without any: other, the next id."""
    names = sorted(classes)
    if not names:
        return entities.select("entity", F.lit(0).alias("class_id"), F.lit("other").alias("label"))
    member = reduce(lambda a, b: a.unionByName(b), [classes[n].select("entity", F.lit(k).alias("class_id")) for k, n in enumerate(names)])
    best = member.groupBy("entity").agg(F.max("class_id").alias("class_id"))
    label = F.element_at(F.array(*[F.lit(n) for n in [*names, "other"]]), F.col("class_id") + 1)
    return entities.select("entity").distinct().join(best, "entity", "left").select("entity", F.coalesce("class_id", F.lit(len(names))).cast("int").alias("class_id")).withColumn("label", label)


def binary(entities: DataFrame, members: DataFrame) -> DataFrame:
    """(entity, label): Y for members, N for the rest."""
    return export(entities, {"Y": members}).select("entity", F.when(F.col("label") == "Y", "Y").otherwise("N").alias("label"))


def by_time(dates: DataFrame, props: list[str], divide: int) -> tuple[DataFrame, DataFrame]:
    """(before, after): entities with any first date below the divide, and those with one at or above it that aren't before."""
    first = dates.where(F.col("prop").isin(props)).groupBy("prop", "entity").agg(F.min_by("year", "pos").alias("year"))
    flags = first.groupBy("entity").agg(F.max((F.col("year") < divide).cast("int")).alias("b"), F.max((F.col("year") >= divide).cast("int")).alias("a"))
    return flags.where("b = 1").select("entity"), flags.where("b = 0 and a = 1").select("entity")


def load_rules(classify: Callable, graph) -> dict[str, DataFrame]:
    """A user's classify(graph) -> {name: set}; the names become the classes of export()."""
    return {str(k): v for k, v in classify(graph).items()}


def cardinality(classes: DataFrame, sample: int = 20) -> DataFrame:
    """(label, n, first_members): sizes of classes (entity, label) with their first members by id, found by a bounded top-k in both stages."""
    n = classes.groupBy("label").agg(F.count("*").alias("n"))
    few = top_k(classes.select("label", "entity").distinct(), ["label"], [F.col("entity")], sample, "entity")
    return n.join(few.groupBy("label").agg(F.sort_array(F.collect_list("entity")).alias("first_members")), "label")


def report(members: DataFrame, edges: DataFrame, props: list[str], n: int = 20) -> DataFrame:
    """(prop, parent, n, percent): the most frequent values of each property among a set's members, ties by id, as shares of the set."""
    size = members.select("entity").distinct()
    own = edges.where(F.col("prop").isin(props)).join(size.select(F.col("entity").alias("child")), "child", "left_semi")
    counted = own.groupBy("prop", "parent").agg(F.count("*").alias("n"))
    total = size.agg(F.count("*")).scalar()
    ranked = top_k(counted, ["prop"], [F.desc("n"), F.col("parent")], n, "parent")
    return ranked.select("prop", "parent", "n", F.round(100.0 * F.col("n") / total, 6).alias("percent"))


@dataclass(frozen=True)
class ClassRule:
    """A class: members of any of the named sets and of none of the sets or classes (given before it) in `without`."""

    name: str
    any: tuple[str, ...]
    without: tuple[str, ...] = ()


def by_rules(graph: TypeGraph, sets: list[Rule], names: dict[int, str], classes: list[ClassRule]) -> dict[str, DataFrame]:
    """The sets of entities of a classification given as data: closures (sets, named by rule_id in names) and classes made of them.

    All closures are one batched loop. Membership is one wide row for each entity that is in any set, with a boolean for each set and class, so that
    the classes are expressions, not joins.
    """
    members = graph.closures(sets)
    flags = members.groupBy("entity").agg(*[F.max((F.col("rule_id") == k).cast("int")).alias(f"s{k}") for k in names])
    place = {n: F.col(f"s{k}") == 1 for k, n in names.items()}
    for c in classes:
        hit = reduce(lambda a, b: a | b, [place[n] for n in c.any])
        for n in c.without:
            hit = hit & ~place[n]
        place[c.name] = hit
    wide = storage.cut(flags.select("entity", *[place[c.name].alias(f"c{i}") for i, c in enumerate(classes)]), "classes")
    return {c.name: wide.where(F.col(f"c{i}")).select("entity") for i, c in enumerate(classes)}


def truth_table(members: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rule_id, entity) of closures restricted to the entities of a corpus, without the rules that hold all of them or none."""
    ids = corpus.select("entity").distinct()
    total = ids.agg(F.count("*")).scalar()
    own = members.select("rule_id", "entity").distinct().join(ids, "entity", "left_semi")
    open_ = own.groupBy("rule_id").agg(F.count("*").alias("n")).where(F.col("n") < total).select("rule_id")
    return own.join(open_, "rule_id", "left_semi").select("rule_id", "entity")


def label_classes(labels: DataFrame, ids: DataFrame, classes: dict[str, DataFrame]) -> DataFrame:
    """labels (..., qid) with the class id of each classification (entity, class_id) by name; a blank or null label has null classes.

    An id that isn't known is an error, as it would silently lose labels.
    """
    known = ids.select("qid", "entity").distinct()
    out = labels.withColumn("qid", F.nullif(F.trim("qid"), F.lit(""))).join(known, "qid", "left")
    wrong = F.raise_error(F.concat(F.lit("unknown label: "), F.col("qid"))).cast("long")
    out = out.withColumn("entity", F.when(F.col("qid").isNotNull() & F.col("entity").isNull(), wrong).otherwise(F.col("entity")))
    for name, c in classes.items():
        out = out.join(c.select("entity", F.col("class_id").alias(name)), "entity", "left")
    return out.drop("entity")
