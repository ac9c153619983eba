"""Searching for a small set of types that best tells mentions apart. Scoring is one distributed query per round; only scores come to the driver."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph import storage
from loomgraph.operators.mentions import prior


def compact(ids: DataFrame) -> DataFrame:
    """(entity, dense): distinct ids with their places in ascending order, from 0.

    Ids are counted in ranges of 65,536 neighbours, the counts summed up, and ids ranked within their range, so that no task ranks them all.
    """
    ids = ids.select("entity", F.expr("entity div 65536").alias("r"))
    counts = ids.groupBy("r").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("r", "before")
    own = ids.withColumn("k", F.row_number().over(W.partitionBy("r").orderBy("entity")) - 1)
    return own.join(before, "r").select("entity", (F.col("before") + F.col("k")).cast("long").alias("dense"))


class Search:
    """mentions (surface_id, entity, n), dictionary (surface_id, entity, cnt), types (entity, type).

    Only mentions that the prior gets wrong are scored again: the truth is never filtered out by its own types, so that
    what the prior solves stays solved. A type set's score is the share of mentions solved, less a penalty for each type.
    """

    def __init__(self, mentions: DataFrame, dictionary: DataFrame, types: DataFrame, penalty: float = 0.0005, auc: dict[int, float] | None = None):
        best = storage.cut(prior(dictionary), "prior")
        joined = mentions.join(best, "surface_id")
        r = joined.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("best") == F.col("entity"), F.col("n"))).alias("greedy")).first()
        self.total, self.greedy, self.penalty, self.auc = r["total"] or 0, r["greedy"] or 0, penalty, auc or {}
        self.rest = storage.cut(joined.where("best <> entity").drop("best"), "rest")
        self.candidates = storage.cut(dictionary.join(self.rest.select("surface_id").distinct(), "surface_id", "left_semi"), "candidates")
        self.types = storage.cut(types, "types")
        self.names = [x["type"] for x in self.types.select("type").distinct().orderBy("type").collect()]  # the types proposed, a list by design
        self.cases = storage.cut(self._cases(), "cases")

    def objective(self, improvement: int, picks: tuple) -> float:
        if not self.total or len(picks) > 400:
            return 0.0
        mean = float(np.mean([self.auc.get(p, 1.0) for p in picks])) if picks else 1.0
        return (self.greedy + improvement * mean) / self.total - self.penalty * len(picks)

    def gains(self, sets: list[tuple[int, ...]]) -> dict[int, int]:
        """By number of the set: mentions solved beside the prior's. All sets are scored in one pass over the cases; a set is one bit."""
        if not sets:
            return {}
        place = {t: k for k, t in enumerate(self.names)}
        asked = np.zeros((max(1, len(place)), -(-len(sets) // 64) * 64), dtype=bool)
        for k, s in enumerate(sets):
            asked[[place[t] for t in s], k] = True
        words, n_sets = np.packbits(asked, axis=1).view(np.uint64), len(sets)

        def score(batches):
            total = np.zeros(n_sets, dtype=np.int64)
            for batch in batches:
                n, rivals = batch.column("n").to_numpy(), batch.column("rivals")
                for at in range(0, len(n), 1024):
                    rows = rivals.slice(at, 1024)
                    pairs = rows.flatten()
                    first = lambda x: np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy())[:-1]))
                    told = np.bitwise_or.reduceat(words[pairs.flatten().to_numpy()], first(pairs), axis=0)
                    solved = np.bitwise_and.reduceat(told, first(rows), axis=0)
                    bits = np.unpackbits(solved.view(np.uint8), axis=1)[:, :n_sets]
                    total += (n[at : at + 1024].astype(np.float64) @ bits.astype(np.float64)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"gain": pa.array([total.tolist()], pa.list_(pa.int64()))})

        parts = [r["gain"] for r in self.cases.mapInArrow(score, "gain array<bigint>").collect()]
        got = np.sum(parts, axis=0, dtype=np.int64) if parts else np.zeros(n_sets, dtype=np.int64)
        return {k: int(got[k]) for k in range(n_sets)}

    def _cases(self) -> DataFrame:
        """(rivals array<array<int>>, n): mentions that types can solve, those of the same rivals together.

        A mention is solved by a set if each candidate above the truth has another combination of the set's types than the truth, thus
        if the set holds one of the types that only one of the two has: a rival is the list of those (as places in names). Of candidates
        with the same types only the highest is a rival, and only it can be solved.
        """
        places = F.broadcast(self.types.sparkSession.createDataFrame([(int(t), k) for k, t in enumerate(self.names)], "type long, k int"))
        own = self.types.join(places, "type").groupBy("entity").agg(F.sort_array(F.collect_set("k")).alias("own"))
        cand = self.candidates.join(own, "entity", "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))
        tops = cand.groupBy("surface_id", "own").agg(F.max(F.struct("cnt", (-F.col("entity")).alias("neg"))).alias("rank"))
        tops = storage.cut(tops, "tops")
        truth = tops.withColumn("entity", -F.col("rank.neg")).join(self.rest, ["surface_id", "entity"]).select("surface_id", "own", "rank", "n")
        pairs = truth.alias("t").join(tops.alias("r"), (F.col("t.surface_id") == F.col("r.surface_id")) & (F.col("r.rank") > F.col("t.rank")))
        apart = F.sort_array(F.array_union(F.array_except("t.own", "r.own"), F.array_except("r.own", "t.own")))
        rivals = pairs.groupBy("t.surface_id", "t.own", "t.n").agg(F.sort_array(F.collect_set(apart)).alias("rivals"))
        return rivals.groupBy("rivals").agg(F.sum("n").alias("n"))

    def round(self, beam: list[tuple[int, ...]]) -> DataFrame:
        """(picks, type, improvement, objective): every extension of the beam by a type it lacks."""
        sets = [(b, t) for b in beam for t in self.names if t not in b]
        gain = self.gains([(*b, t) for b, t in sets])
        rows = [(",".join(map(str, b)), int(t), int(gain[k]), round(self.objective(gain[k], (*b, t)), 6)) for k, (b, t) in enumerate(sets)]
        return self.types.sparkSession.createDataFrame(rows, "picks string, type long, improvement long, objective double")

    def best_single(self) -> DataFrame:
        gain = self.gains([(t,) for t in self.names])
        best = max(gain.values(), default=0)
        return self.types.sparkSession.createDataFrame([(round(self.greedy / self.total, 6), round((self.greedy + best) / self.total, 6))] if self.total else [], "base double, best_one double")

    def one_type_tops(self) -> DataFrame:
        """(type, surface_id, has, best): of the first type, the highest candidate among those that have it and those that don't."""
        first = self.types.agg(F.min("type").alias("type"))
        has = self.types.join(first, "type").select("entity", F.lit(True).alias("has"))
        cand = self.candidates.join(has, "entity", "left").withColumn("has", F.coalesce("has", F.lit(False)))
        top = cand.groupBy("surface_id", "has").agg(F.max(F.struct("cnt", (-F.col("entity")).alias("neg"))).alias("b"))
        return top.select(F.lit(self.names[0] if self.names else None).cast("long").alias("type"), "surface_id", "has", (-F.col("b.neg")).alias("best"))

    def _result(self, picks: tuple, gain: int) -> DataFrame:
        rows = [(k, int(t), round(self.objective(gain, picks), 6)) for k, t in enumerate(sorted(picks))]
        return self.types.sparkSession.createDataFrame(rows, "place int, type long, objective double")

    def best_types(self, n: int) -> DataFrame:
        """(type, improvement, objective) of the n best single types; ties go to the smaller one."""
        return self.round([()]).orderBy(F.desc("objective"), "type").limit(n).select("type", "improvement", "objective")

    def solve(self, width: int = 8, most: int | None = None, subset: int | None = None) -> DataFrame:
        """(place, type, objective) by beam search (greedy with width 1): each candidate is kept as stopped beside its extensions; ends when all have stopped, or after `most` rounds if given.

        With subset only the so many best single types are tried.
        """
        tried = self.names if subset is None else [r["type"] for r in self.best_types(subset).collect()]
        beam: list[tuple[float, tuple, int, bool]] = [(self.objective(0, ()), (), 0, False)]
        for _ in itertools.count() if most is None else range(most):
            live = [b for b in beam if not b[3]]
            if not live:
                break
            sets = list(dict.fromkeys(tuple(sorted((*b[1], t))) for b in live for t in tried if t not in b[1]))
            gain = self.gains(sets)
            grown = [(self.objective(gain[k], s), s, gain[k], False) for k, s in enumerate(sets)]
            stopped = [(b[0], b[1], b[2], True) for b in beam]
            beam = sorted(grown + stopped, key=lambda x: (-x[0], x[1]))[:width]
        return self._result(beam[0][1], beam[0][2])

    def cross_entropy(self, samples: int = 1000, rounds: int = 500, elite: float = 0.2, seed: int = 1) -> DataFrame:
        """By sampling sets and moving each type's probability to its share among the best fifth."""
        rng = np.random.default_rng(seed)
        n = max(1, len(self.names))
        p, best = np.full(len(self.names), min(0.5, 50 / n)), (self.objective(0, ()), (), 0)
        for _ in range(rounds):
            draw = rng.random((samples, len(self.names))) < p
            sets = [tuple(t for t, on in zip(self.names, row, strict=True) if on) for row in draw]
            gain = self.gains(sets)
            score = np.array([self.objective(gain[k], s) for k, s in enumerate(sets)])
            top = np.argsort(-score, kind="stable")[: max(1, int(samples * elite))]
            if score[top[0]] > best[0]:
                best = (score[top[0]], sets[top[0]], gain[int(top[0])])
            p = draw[top].mean(0)
            if ((p == 0) | (p == 1)).all():
                break
        return self._result(best[1], best[2])

    def genetic(self, size: int = 1000, generations: int = 40, cross: float = 0.2, mutate: float = 0.5, seed: int = 1) -> DataFrame:
        """By tournaments of three, two-point crossover and flips; the best of the last generation."""
        rng = np.random.default_rng(seed)
        n = len(self.names)
        pop = rng.random((size, n)) < min(0.5, 50 / max(1, n))
        sets = [tuple(t for t, on in zip(self.names, row, strict=True) if on) for row in pop]
        gain = self.gains(sets)
        score = np.array([self.objective(gain[k], s) for k, s in enumerate(sets)])
        for _ in range(generations):
            draw = rng.integers(0, size, (size, 3))
            pop = pop[draw[np.arange(size), score[draw].argmax(1)]].copy()
            for i in range(0, size - 1, 2):
                if rng.random() < cross and n > 1:
                    a, b = sorted(rng.integers(0, n, 2))
                    pop[i, a:b], pop[i + 1, a:b] = pop[i + 1, a:b].copy(), pop[i, a:b].copy()
            flips = (rng.random((size, 1)) < mutate) & (rng.random((size, n)) < min(1.0, 10 / max(1, n)))
            pop ^= flips
            sets = [tuple(t for t, on in zip(self.names, row, strict=True) if on) for row in pop]
            gain = self.gains(sets)
            score = np.array([self.objective(gain[k], s) for k, s in enumerate(sets)])
        k = int(score.argmax())
        return self._result(sets[k], gain[k])


def solution_configs(picks: DataFrame, names: DataFrame, files: dict[str, str]) -> dict[str, dict]:
    """What a solution (place, type) is handed on as: the disambiguator's and the model's configuration. names (type, name), files: paths by role.

    Each type is a classification of its own with the classes N and Y.
    """
    rows = picks.join(names.groupBy("type").agg(F.min("name").alias("name")), "type", "left").orderBy("place").collect()  # the types picked
    labels = [{"name": r["name"] or f"type_{r['type']}", "type": int(r["type"])} for r in rows]
    return {
        "disambiguator": {**files, "classification": [f"{files.get('classifications', 'classifications')}/{x['name']}" for x in labels]},
        "model": {
            "objectives": [{"name": x["name"], "type": "softmax", "vocab": ["N", "Y"]} for x in labels],
            "datasets": [{"type": "train", "path": files.get("train", ""), "y": [{"column": 1, "objective": x["name"], "classification": x["name"]} for x in labels]}],
        },
    }
