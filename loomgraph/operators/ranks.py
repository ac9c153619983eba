"""Ranks and top-k in groups of any size: no task ever sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Buckets that a group is spread over before its top-k is taken.
BUCKETS = 64


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int, spread: str) -> DataFrame:
    """rows with k_no (1 to k) by group and order: first the top k of each hashed bucket of `spread`, then of the at most k * BUCKETS rows left."""
    part = rows.withColumn("__b", F.pmod(F.xxhash64(spread), F.lit(BUCKETS)))
    few = part.withColumn("__k", F.row_number().over(W.partitionBy(*group, "__b").orderBy(*order))).where(F.col("__k") <= k).drop("__b", "__k")
    return few.withColumn("k_no", F.row_number().over((W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy(*order)).cast("int")).where(F.col("k_no") <= k)


def rank_in_order(rows: DataFrame, group: list[str], leading: list[Column], number: str, rest: list[str], span: int = 4096) -> DataFrame:
    """rows with rank (1 ...) within group, ordered by leading, then number (a long), then rest.

    Rows are counted by stretch of `span` numbers, the counts summed up in order, and rows ranked within their stretch.
    """
    lead = [f"__l{i}" for i in range(len(leading))]
    rows = rows.withColumns({n: c for n, c in zip(lead, leading, strict=True)} | {"__s": F.expr(f"{number} div {span}")})
    keys = [*group, *lead, "__s"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    level = counts.groupBy(*group, *lead).agg(F.sum("__n").alias("__m"))
    whole = W.partitionBy(*group).orderBy(*lead) if group else W.orderBy(*lead)
    above = level.withColumn("__above", F.sum("__m").over(whole.rowsBetween(W.unboundedPreceding, 0)) - F.col("__m")).drop("__m") if lead else None
    stretch = counts.withColumn("__before", F.sum("__n").over((W.partitionBy(*group, *lead) if group or lead else W.partitionBy(F.lit(0))).orderBy("__s").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    if above is not None:
        stretch = stretch.join(above, [*group, *lead]).withColumn("__before", F.col("__before") + F.col("__above")).drop("__above")
    own = rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(number, *rest)))
    return own.join(stretch, keys).withColumn("rank", F.col("__before") + F.col("__k")).drop(*lead, "__s", "__k", "__before")
