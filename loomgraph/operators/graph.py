"""Typed entity graphs: relations, and closures over several of them with forbidden nodes and links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph import storage
from loomgraph.operators.ranks import rank_in_order


@dataclass(frozen=True)
class Rule:
    """A set of entities: all that reach one of the seeds by the relations, within max_steps if given."""

    rule_id: int
    relations: tuple[str, ...]
    seeds: tuple[int, ...]
    max_steps: int | None = None


class TypeGraph:
    """edges (prop, child, parent, pos): child has parent as a value of prop. bad_nodes (entity) and bad_pairs (child, parent) are never crossed."""

    def __init__(self, edges: DataFrame, bad_nodes: DataFrame | None = None, bad_pairs: DataFrame | None = None):
        self.edges, self.bad_nodes, self.bad_pairs = edges, bad_nodes, bad_pairs

    def relation(self, name: str) -> DataFrame:
        """(source, target) of a relation; name.inv goes the other way."""
        prop, _, way = name.partition(".")
        source, target = ("parent", "child") if way == "inv" else ("child", "parent")
        return self.edges.where(F.col("prop") == prop).select(F.col(source).alias("source"), F.col(target).alias("target"))

    def inverted(self, prop: str) -> DataFrame:
        """(parent, pos, child): children by parent with their places in ascending order; a parent may have any number of them."""
        own = self.edges.where(F.col("prop") == prop).select("parent", "child").distinct()
        return rank_in_order(own, ["parent"], [], "child", []).select("parent", (F.col("rank") - 1).alias("pos"), "child")

    def out_degree(self, entities: DataFrame, prop: str) -> DataFrame:
        n = self.edges.where(F.col("prop") == prop).groupBy(F.col("child").alias("entity")).agg(F.count("*").alias("n"))
        return entities.select("entity").join(n, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))

    def edges_of(self, members: DataFrame) -> DataFrame:
        """The edges that go out of a set (entity)."""
        return self.edges.join(members.select(F.col("entity").alias("child")).distinct(), "child", "left_semi")

    def successors(self, relations: list[str], members: DataFrame) -> DataFrame:
        """(entity): one hop down from a set, over any of the relations; forbidden links aren't followed, forbidden nodes are reached."""
        front = members.select(F.col("entity").alias("parent")).distinct()
        links = self.edges.where(F.col("prop").isin(list(relations))).select("child", "parent")
        return self._allowed(links.join(front, "parent", "left_semi")).select(F.col("child").alias("entity")).distinct()

    def _allowed(self, links: DataFrame) -> DataFrame:
        return links if self.bad_pairs is None else links.join(self.bad_pairs, ["child", "parent"], "left_anti")

    def _good(self, nodes: DataFrame) -> DataFrame:
        return nodes if self.bad_nodes is None else nodes.join(self.bad_nodes.select("entity").distinct(), "entity", "left_anti")

    def satisfy(self, relations: list[str], seeds: list[int] | DataFrame, max_steps: int | None = None) -> DataFrame:
        """(entity): the closure of one rule. Seeds may be a computed set (entity)."""
        if not relations:
            raise ValueError("a closure needs at least one relation")
        spark = self.edges.sparkSession
        if isinstance(seeds, DataFrame):
            start = seeds.select(F.lit(0).alias("rule_id"), F.col("entity").cast("long").alias("entity"))
        else:
            start = spark.createDataFrame([(0, int(s)) for s in seeds], "rule_id int, entity long")
        return self._closures(start, {0: tuple(relations)}, {0: max_steps}).select("entity")

    def closures(self, rules: list[Rule]) -> DataFrame:
        """(rule_id, entity) of many rules in one loop: as many rounds as the deepest rule needs, not as there are rules."""
        if any(not r.relations for r in rules):
            raise ValueError("a closure needs at least one relation")
        start = self.edges.sparkSession.createDataFrame([(r.rule_id, int(s)) for r in rules for s in r.seeds], "rule_id int, entity long")
        return self._closures(start, {r.rule_id: r.relations for r in rules}, {r.rule_id: r.max_steps for r in rules})

    def _closures(self, start: DataFrame, relations: dict[int, tuple[str, ...]], steps: dict[int, int | None]) -> DataFrame:
        """Semi-naive: only what was new in a round is expanded in the next, so that cycles end. A forbidden seed is expanded once but
        is no member; a forbidden node is neither."""
        spark = self.edges.sparkSession
        by_rule = F.broadcast(spark.createDataFrame([(r, p, steps[r] if steps[r] is not None else 1 << 30) for r, ps in relations.items() for p in ps], "rule_id int, prop string, most int"))
        props = sorted({p for ps in relations.values() for p in ps})
        links = storage.cut(self._allowed(self.edges.where(F.col("prop").isin(props)).select("prop", F.col("child").cast("long"), F.col("parent").cast("long")).distinct()), "links")
        front = storage.cut(start.distinct(), "front")
        members = [storage.cut(self._good(front), "members")]
        step = 0
        while not front.isEmpty():
            step += 1
            asked = front.join(by_rule.where(F.col("most") >= step), "rule_id").select("rule_id", "prop", F.col("entity").alias("parent"))
            new = asked.join(links, ["prop", "parent"]).select("rule_id", F.col("child").alias("entity")).distinct()
            for m in members:
                new = new.join(m, ["rule_id", "entity"], "left_anti")
            front = storage.cut(self._good(new), "front")
            members.append(front)
            if len(members) > 4:  # keeps the number of anti-joins bounded
                merged = storage.cut(_union(members), "members")
                storage.drop(*(m for m in members if m is not front))
                members = [merged]
        return _union(members)

    def connection_path(self, relations: list[str], sources: DataFrame, target: int, most: int | None = None) -> DataFrame:
        """(entity, path array<string>): of each source a shortest way up to the target as node, relation, node ...; ties by the path's text.

        Sources that don't reach the target, or not within `most` steps if given, have no row. The search goes down from the target,
        once for all sources, until a round finds nothing new; what was found is never entered again, so that cycles end.
        """
        spark = self.edges.sparkSession
        links = storage.cut(self._allowed(self.edges.where(F.col("prop").isin(list(relations))).select("prop", F.col("child").cast("long"), F.col("parent").cast("long")).distinct()), "links")
        front = storage.cut(spark.createDataFrame([(int(target), [str(target)])], "entity long, path array<string>"), "paths")
        found, seen = [front], [front.select("entity")]
        while most is None or len(found) <= most:
            nxt = front.select(F.col("entity").alias("parent"), "path").join(links, "parent")
            nxt = nxt.select(F.col("child").alias("entity"), F.concat(F.array(F.col("child").cast("string"), F.col("prop")), F.col("path")).alias("path"))
            nxt = self._good(nxt.groupBy("entity").agg(F.min("path").alias("path")))
            for s in seen:
                nxt = nxt.join(s, "entity", "left_anti")
            front = storage.cut(nxt, "paths")
            if front.isEmpty():
                break
            found.append(front)
            seen.append(front.select("entity"))
            if len(seen) > 4:  # keeps the number of anti-joins bounded
                merged = storage.cut(_union(seen), "seen")
                storage.drop(seen[0])
                seen = [merged]
        return _union(found).join(sources.select(F.col("entity").cast("long")).distinct(), "entity", "left_semi")

    def path_reach(self, starts: DataFrame, steps: list[tuple[str, int]]) -> DataFrame:
        """(source, entity): what each start (entity) reaches by a typed path. A step (relation, n) is 1 to n hops; forbidden nodes don't matter here."""
        cursor = starts.select(F.col("entity").cast("long").alias("source"), F.col("entity").cast("long").alias("entity")).distinct()
        for relation, most in steps:
            links = self.relation(relation).select(F.col("source").cast("long").alias("entity"), F.col("target").cast("long").alias("target")).distinct()
            reached, front = [], cursor
            for _ in range(most):
                front = front.join(links, "entity").select("source", F.col("target").alias("entity")).distinct()
                for r in reached:
                    front = front.join(r, ["source", "entity"], "left_anti")
                front = storage.cut(front, "reach")
                if front.isEmpty():
                    break
                reached.append(front)
            if not reached:
                return front
            cursor = _union(reached)
        return cursor


class ClosureCache:
    """Closures of a graph kept by relations, seeds and steps, for rules of fewer than 100 seeds. Of more than `most` the half used least goes."""

    def __init__(self, graph: TypeGraph, most: int = 200):
        self.graph, self.most, self.kept, self.used = graph, most, {}, {}

    def satisfy(self, relations: list[str], seeds: list[int], max_steps: int | None = None) -> DataFrame:
        key = (tuple(sorted(relations)), tuple(sorted(seeds)), max_steps)
        if len(seeds) >= 100:
            return self.graph.satisfy(relations, seeds, max_steps)
        if key not in self.kept:
            if len(self.kept) >= self.most:
                for old in sorted(self.kept, key=self.used.__getitem__)[: -(-self.most // 2)]:
                    storage.drop(self.kept.pop(old))
                    del self.used[old]
            self.kept[key], self.used[key] = storage.cut(self.graph.satisfy(relations, seeds, max_steps), "closure"), 0
        self.used[key] += 1
        return self.kept[key]

    def forbid(self, bad_nodes: DataFrame | None, bad_pairs: DataFrame | None) -> None:
        """Another blacklist: nothing kept holds any more."""
        self.graph = TypeGraph(self.graph.edges, bad_nodes, bad_pairs)
        storage.drop(*self.kept.values())
        self.kept, self.used = {}, {}


def describe_connection(graph: TypeGraph, ids: DataFrame, names: DataFrame, source: str, target: str, relations: list[str]) -> str | None:
    """A shortest way from source to target, ids or titles, as names joined by arrows; None if there is none. ids (entity, qid), names (entity, name)."""

    def number(what: str) -> int:
        hit = ids.where(F.col("qid") == what).select("entity").union(names.where(F.col("name") == what).select("entity")).agg(F.min("entity")).first()[0]
        if hit is None:
            raise ValueError(f"unknown: {what}")
        return int(hit)

    a, z = number(source), number(target)
    found = graph.connection_path(relations, graph.edges.sparkSession.createDataFrame([(a,)], "entity long"), z).first()
    if found is None:
        return None
    steps = list(found["path"])
    known = {str(r["entity"]): r["name"] for r in names.where(F.col("entity").isin([int(x) for x in steps[::2]])).groupBy("entity").agg(F.min("name").alias("name")).collect()}  # one way's nodes
    return "".join(known.get(x, f"#{x}") if k % 2 == 0 else f" -{x}-> " for k, x in enumerate(steps))


def without_deleted(edges: DataFrame, value: str = "parent") -> DataFrame:
    """edges (prop, child, value, pos) without negative values, their positions made dense again."""
    w = W.partitionBy("prop", "child").orderBy("pos")
    return edges.where(F.col(value) >= 0).withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


def from_lists(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(key, pos, value) of an array column; rows whose array is null or empty have none."""
    return rows.select(key, F.posexplode(values).alias("pos", "value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
