"""Counting surfaces and entities, candidates of mentions, and how well types tell candidates apart.

Nothing here pairs candidates with each other: what a mention needs to know of its rivals is gathered per surface, or per
surface and combination of classes, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ranks import top_k
from loomgraph.operators.sequences import chance


def prior(dictionary: DataFrame) -> DataFrame:
    """(surface_id, best): the candidate with the highest count; ties go to the smaller entity."""
    return dictionary.groupBy("surface_id").agg(F.max(F.struct("cnt", (-F.col("entity")).alias("neg"))).alias("b")).select("surface_id", (-F.col("b.neg")).alias("best"))


def _tops(candidates: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, top, tied, best): how many candidates, the highest count, how many have it, and the smallest entity of those.

    In two steps of hash aggregation, by keys and count first, so that no group is sorted.
    """
    by_count = candidates.groupBy(*keys, "cnt").agg(F.count("*").alias("k"), F.min("entity").alias("e"))
    return _merge_tops(by_count.select(*keys, F.col("k").alias("n"), F.col("cnt").alias("top"), F.col("k").alias("tied"), F.col("e").alias("best")), *keys)


def _merge_tops(tops: DataFrame, *keys: str) -> DataFrame:
    level = tops.groupBy(*keys, "top").agg(F.sum("n").alias("n"), F.sum("tied").alias("tied"), F.min("best").alias("best"))
    out = level.groupBy(*keys).agg(F.sum("n").alias("n"), F.max(F.struct("top", "tied", "best")).alias("m"))
    return out.select(*keys, "n", "m.top", "m.tied", "m.best")


def outcomes(mentions: DataFrame, dictionary: DataFrame, classes: list[DataFrame], other: int | None = None) -> DataFrame:
    """One row per (surface_id, entity) of mentions (surface_id, entity, n), with which methods tell the true entity.

    classes: for each oracle a classification (entity, class_id); a candidate without a class has class `other`. Columns obvious (one
    candidate), greedy (the prior is right), and for each of strict, ignore_other and keep_other whether at most one
    candidate is left, or more and the highest count alone belongs to the truth (…_counts).
    strict keeps candidates of the truth's class in every oracle; ignore_other skips an oracle in which any candidate is `other`;
    keep_other skips it if the truth is `other`, and keeps candidates of class `other` besides those of the truth's class.
    """
    names = [f"c{k}" for k in range(len(classes))]
    cand = dictionary.select("surface_id", "entity", "cnt")
    for name, c in zip(names, classes, strict=True):
        cand = cand.join(c.select("entity", F.col("class_id").alias(name)), "entity", "left")
        cand = cand.withColumn(name, F.coalesce(name, F.lit(-1 if other is None else other)))
    groups = _tops(cand, "surface_id", *names)  # per surface at most as many rows as combinations of classes
    surface = _tops(cand, "surface_id").select("surface_id", F.col("n").alias("n_all"), F.col("best").alias("prior"))
    flags = groups.groupBy("surface_id").agg(*[F.max(F.col(c) == F.lit(other)).alias(f"any_{c}") for c in names])
    truth = mentions.join(cand.select("surface_id", "entity", *names), ["surface_id", "entity"]).join(surface, "surface_id").join(flags, "surface_id")
    out = truth.withColumn("obvious", F.col("n_all") == 1).withColumn("greedy", F.col("prior") == F.col("entity"))
    matches = {}
    for mode in ("strict", "ignore_other", "keep_other"):
        match = None
        for c in names:
            same = F.col(f"t.{c}") == F.col(f"g.{c}")
            if mode == "ignore_other":
                same = same | F.col(f"t.any_{c}")
            elif mode == "keep_other":
                same = same | (F.col(f"t.{c}") == F.lit(other)) | (F.col(f"g.{c}") == F.lit(other))
            match = same if match is None else match & same
        matches[mode] = match
    # combinations of classes of one surface are paired once; a pair counts for each mode it matches in, strict ones for all
    kinds = flags.join(groups.select("surface_id", *names), "surface_id")
    pairs = kinds.alias("t").join(groups.alias("g"), (F.col("t.surface_id") == F.col("g.surface_id")) & (matches["ignore_other"] | matches["keep_other"]))
    modes = F.explode(F.filter(F.array(*[F.when(m, F.lit(n)) for n, m in matches.items()]), lambda x: x.isNotNull()))
    each = pairs.select(F.col("t.surface_id").alias("surface_id"), *[F.col(f"t.{c}").alias(c) for c in names], modes.alias("mode"), "g.n", "g.top", "g.tied", "g.best")
    tops = _merge_tops(each, "surface_id", *names, "mode")
    found = F.struct("n", "tied", "best")
    solved = tops.groupBy("surface_id", *names).agg(*[F.max(F.when(F.col("mode") == m, found)).alias(f"m_{m}") for m in matches])
    out = out.join(solved, ["surface_id", *names])
    for mode in matches:
        m = f"m_{mode}"
        out = out.withColumn(mode, F.col(f"{m}.n") <= 1).withColumn(f"{mode}_counts", (F.col(f"{m}.n") <= 1) | ((F.col(f"{m}.tied") == 1) & (F.col(f"{m}.best") == F.col("entity")))).drop(m)
    return out.drop(*[f"any_{c}" for c in names], *names)


def report(out: DataFrame) -> DataFrame:
    """One row: mentions that are obvious or ambiguous, and of the ambiguous those solved by each method."""
    hard = ~F.col("obvious")
    solved = lambda c: F.coalesce(F.sum(F.when(hard & F.col(c), F.col("n"))), F.lit(0)).cast("long")
    return out.agg(
        F.coalesce(F.sum(F.when(hard, F.col("n"))), F.lit(0)).cast("long").alias("ambiguous"),
        F.coalesce(F.sum(F.when(F.col("obvious"), F.col("n"))), F.lit(0)).cast("long").alias("obvious"),
        *[solved(c).alias(a) for c, a in (("greedy", "greedy"), ("strict", "oracle"), ("strict_counts", "oracle_counts"), ("ignore_other_counts", "oracle_ignore_other"), ("keep_other_counts", "oracle_keep_other"))],
    )


def percentages(row: DataFrame) -> DataFrame:
    """The report as percentages of the ambiguous mentions, and of all with the obvious ones counted as solved."""
    methods = ["greedy", "oracle", "oracle_counts", "oracle_ignore_other", "oracle_keep_other"]
    pct = lambda a, b: F.round(F.when(b > 0, 100.0 * a / b), 6)
    every = F.col("ambiguous") + F.col("obvious")
    return row.select(*[pct(F.col(m), F.col("ambiguous")).alias(m) for m in methods], *[pct(F.col(m) + F.col("obvious"), every).alias(f"{m}_all") for m in methods])


def apply_transitions(mentions: DataFrame, transitions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions with their entity moved to what it was repaired to; -1 if it has no transition, was deleted or is no candidate any more."""
    moved = mentions.join(transitions.select("surface_id", F.col("old_entity").alias("entity"), "new_entity"), ["surface_id", "entity"], "left")
    ok = dictionary.select("surface_id", F.col("entity").alias("new_entity"), F.lit(True).alias("known")).distinct()
    return moved.join(ok, ["surface_id", "new_entity"], "left").select("surface_id", F.col("entity").alias("old_entity"), F.when(F.col("known"), F.col("new_entity")).otherwise(F.lit(-1)).cast("long").alias("entity"), "n")


def with_share(dictionary: DataFrame) -> DataFrame:
    """dictionary with each candidate's percentage of its surface's counts."""
    total = dictionary.groupBy("surface_id").agg(F.sum("cnt").alias("total"))
    return dictionary.join(total, "surface_id").withColumn("percent", F.round(100.0 * F.col("cnt") / F.col("total"), 6))


def ambiguity(out: DataFrame, method: str, label: DataFrame, top: int = 6) -> DataFrame:
    """(label, n, surface_id, surface_n, k): where the method fails, by the truth's label: the total and the most frequent surfaces."""
    bad = out.where(~F.col("obvious") & ~F.col(method)).join(label, "entity")
    by = bad.groupBy("label", "surface_id").agg(F.sum("n").alias("surface_n"))
    total = by.groupBy("label").agg(F.sum("surface_n").alias("n"))
    ranked = top_k(by, ["label"], [F.desc("surface_n"), F.col("surface_id")], top, "surface_id")
    return ranked.join(total, "label").select("label", "n", "surface_id", "surface_n", F.col("k_no").alias("k"))


def proposals(edges: DataFrame, categories: DataFrame, corpus: DataFrame, seed: int = 0) -> DataFrame:
    """(relation, type, n, draw): what entities of the corpus (entity) are instances of, and the main articles of their categories (child, parent), by how
    many have it; draw is a number by chance that shuffles types of equal standing the same way each time."""
    kinds = edges.where("prop = 'P31'").select(F.lit("P31").alias("relation"), F.col("parent").alias("type"), F.col("child").alias("entity"))
    both = kinds.unionByName(categories.select(F.lit("category").alias("relation"), F.col("parent").alias("type"), F.col("child").alias("entity"))).distinct()
    n = both.join(corpus.select("entity").distinct(), "entity", "left_semi").groupBy("relation", "type").agg(F.count("*").alias("n"))
    return n.withColumn("draw", chance("type", "relation", seed=seed))
