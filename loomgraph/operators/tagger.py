"""Tagging token sequences with any model that gives class probabilities, and a plain one that counts word endings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ranks import top_k


class Model(Protocol):
    classes: list[str]

    def predict_proba(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """By sentence an array tokens x classes."""


@dataclass
class EndingModel:
    """Class probabilities of a token's last characters, counted and smoothed; endings not seen have the base rates."""

    classes: list[str]
    base: np.ndarray
    known: dict[str, np.ndarray]
    size: int

    def predict_proba(self, sentences: list[list[str]]) -> list[np.ndarray]:
        return [np.array([self.known.get(t[-self.size :], self.base) for t in s]).reshape(len(s), len(self.classes)) for s in sentences]


def fit_endings(tokens: DataFrame, token: str, label: str, size: int = 3, most: int = 50_000) -> EndingModel:
    """From labelled tokens; the `most` most frequent (ending, label) pairs are kept, which bounds the model."""
    counted = tokens.where(F.col(label).isNotNull() & (F.col(token) != "")).groupBy(F.substring(token, -size, size).alias("e"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    total = {r["l"]: r["n"] for r in counted.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # one row for each class
    classes = sorted(total)
    base = np.array([total[c] for c in classes], float) / max(1, sum(total.values()))
    known: dict[str, np.ndarray] = {}
    for r in top_k(counted, [], [F.desc("n"), F.col("e"), F.col("l")], most, "e").collect():
        known.setdefault(r["e"], base.copy())[classes.index(r["l"])] += r["n"]
    return EndingModel(classes, base, {e: x / x.sum() for e, x in known.items()}, size)


def predict_proba(sentences: DataFrame, sequence: str, tokens: str, model: Model) -> DataFrame:
    """(sequence, pos, token, probabilities array) of each token of sentences (sequence, tokens array); empty and null sentences have none."""
    shared = sentences.sparkSession.sparkContext.broadcast(model)  # bounded by the model

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            words = [[str(x) for x in t] for t in f["t"]]
            p = shared.value.predict_proba(words)
            n = [len(w) for w in words]
            yield pd.DataFrame({"id": np.repeat(f["id"].to_numpy(), n), "pos": [k for w in words for k in range(len(w))], "token": [x for w in words for x in w], "probabilities": [row.tolist() for x in p for row in x]})

    kind = dict(sentences.dtypes)[sequence]
    few = sentences.where(F.size(tokens) > 0).select(F.col(sequence).alias("id"), F.transform(tokens, lambda t: F.coalesce(t, F.lit(""))).alias("t"))
    return few.mapInPandas(run, f"id {kind}, pos int, token string, probabilities array<double>").withColumnRenamed("id", sequence)


def tag_sentences(sentences: DataFrame, sequence: str, tokens: str, model: Model, k: int = 5, least: float = 0.0) -> DataFrame:
    """(sequence, pos, token, tags array<struct<tag, probability>>): the k most probable classes of each token with at least that probability, ties by name."""
    names = F.array(*[F.lit(c) for c in model.classes])
    pairs = F.transform("probabilities", lambda p, i: F.struct((-p).alias("neg"), F.element_at(names, i + 1).alias("tag")))
    best = F.filter(F.slice(F.sort_array(pairs), 1, k), lambda x: -x["neg"] >= least)
    return predict_proba(sentences, sequence, tokens, model).select(sequence, "pos", "token", F.transform(best, lambda x: F.struct(x["tag"].alias("tag"), (-x["neg"]).alias("probability"))).alias("tags"))
