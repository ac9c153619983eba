"""Ranking and tagging metrics by aggregation, and sequence decoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _levels(rows: DataFrame, group: str) -> DataFrame:
    """(group, score, p, n): positives and negatives of each distinct score. Windows run over distinct scores, not rows."""
    return rows.groupBy(group, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))


def auc(rows: DataFrame, group: str) -> DataFrame:
    """(group, auc) of rows (group, y 0 or 1, score): ties count half. Groups of one class have no row."""
    below = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = _levels(rows, group).withColumn("won", F.col("p") * (below + F.col("n") / 2.0))
    out = part.groupBy(group).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n")).where("p > 0 and n > 0")
    return out.select(group, F.round(F.col("won") / (F.col("p") * F.col("n")), 6).alias("auc"))


def auc_average(aucs: DataFrame, group: str, above: float) -> DataFrame:
    """(group, n, mean, std) of the areas (group, auc) of several runs; groups whose mean isn't above the bound go."""
    out = aucs.groupBy(group).agg(F.count("*").alias("n"), F.avg("auc").alias("m"), F.stddev_pop("auc").alias("s"))
    return out.where(F.col("m") > above).select(group, "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"))


def average_precision(rows: DataFrame, group: str) -> DataFrame:
    """(group, average_precision): precision at each distinct threshold, weighted by the recall gained there."""
    w = W.partitionBy(group).orderBy(F.desc("score"))
    part = _levels(rows, group).withColumn("tp", F.sum("p").over(w)).withColumn("all", F.sum(F.col("p") + F.col("n")).over(w))
    out = part.groupBy(group).agg(F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("s"), F.sum("p").alias("p")).where("p > 0")
    return out.select(group, F.round(F.col("s") / F.col("p"), 6).alias("average_precision"))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(class, tp, fp, fn)."""
    one = F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t")), F.struct(F.col(guess).alias("class"), F.lit(0).alias("t"))))
    hit = F.col(truth) == F.col(guess)
    per = rows.select(hit.alias("hit"), one.alias("x")).select("hit", "x.class", "x.t")
    return per.groupBy("class").agg(F.count_if(F.col("hit") & (F.col("t") == 1)).alias("tp"), F.count_if(~F.col("hit") & (F.col("t") == 0)).alias("fp"), F.count_if(~F.col("hit") & (F.col("t") == 1)).alias("fn"))


def weighted_f1(counts: DataFrame) -> DataFrame:
    """(precision, recall, f1) in percent, weighted by support; denominators are at least 1e-6, so that an empty class is 0 and not NaN."""
    floor = lambda c: F.greatest(c, F.lit(1e-6))
    p, r = F.col("tp") / floor(F.col("tp") + F.col("fp")), F.col("tp") / floor(F.col("tp") + F.col("fn"))
    per = counts.select(p.alias("p"), r.alias("r"), (F.col("tp") + F.col("fn")).alias("support")).withColumn("f", 2 * F.col("p") * F.col("r") / floor(F.col("p") + F.col("r")))
    mean = lambda c: F.round(100 * F.sum(F.col(c) * F.col("support")) / floor(F.sum("support")), 6)
    return per.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))


def sequence_accuracy(rows: DataFrame, doc: str, truth: str, guess: str) -> DataFrame:
    """(tokens, token_correct, sentences, sentence_correct) over rows with a truth; a sentence is right if all its tokens are."""
    per = rows.where(F.col(truth).isNotNull()).groupBy(doc).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(guess)).alias("k"))
    return per.agg(F.sum("n").alias("tokens"), F.sum("k").alias("token_correct"), F.count("*").alias("sentences"), F.count_if(F.col("n") == F.col("k")).alias("sentence_correct"))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, stable against large ones."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def top_k(scores: Column, k: int) -> Column:
    """The k best (score, place) of an array, ties by place."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("place")))
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda s: F.struct((-s["neg"]).alias("score"), s["place"].alias("place")))


def viterbi(scores: np.ndarray, transition: np.ndarray) -> tuple[list[int], float]:
    """The best path through scores (steps x tags) and transition (from x to), and its score; of equal ones the lower tags."""
    if not len(scores):
        return [], 0.0
    best, back = scores[0].astype(float), []
    for s in scores[1:]:
        total = best[:, None] + transition
        back.append(total.argmax(0))
        best = total.max(0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(best.max())


def viterbi_decode(rows: DataFrame, doc: str, pos: str, scores: str, transition: np.ndarray) -> DataFrame:
    """(doc, pos, tag): the best tag sequence of each document by its scores arrays."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        path, _ = viterbi(np.array(f["s"].tolist(), float), transition)
        return pd.DataFrame({"doc": f["doc"], "pos": f["pos"], "tag": path})

    kinds = dict(rows.dtypes)
    few = rows.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.col(scores).alias("s"))
    out = few.groupBy("doc").applyInPandas(run, f"doc {kinds[doc]}, pos {kinds[pos]}, tag int")
    return out.withColumnRenamed("doc", doc).withColumnRenamed("pos", pos)
