"""Keys that hold a large share of all rows: finding them, aggregating and joining past them.

Every operator here gives the same rows as the plain groupBy or join; hot keys only change how the work is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys tracked by the sketch: its error is about 3.5 / 16384 of all rows, so that each key above 1/2000 is found.
TRACKED = 10_000
#: At most so many keys count as hot; with the least share of 1/1000 there can't be more.
MOST_HOT = 1_000


def heavy_keys(df: DataFrame, key: Column, least_share: float = 0.002) -> list:
    """The values of key holding at least least_share (1/1000 or more) of df's rows, by one mergeable frequent-items sketch.

    The list has at most 1/least_share entries whatever the size of df. It guides only the spreading of work, so that
    keys near the threshold may be in or out. Null keys and empty tables give no entries.
    """
    if least_share < 1 / MOST_HOT:
        raise ValueError("least_share is 1/1000 or more")
    row = df.select(key.alias("k")).where("k is not null").agg(F.expr(f"approx_top_k(k, {MOST_HOT}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    n = row["n"] or 0
    return sorted(x["item"] for x in (row["top"] or []) if x["count"] >= max(2, least_share * n))


def salted_totals(rows: DataFrame, keys: list[str], aggs: dict[str, Column], merges: dict[str, Column], hot: Column, spread: Column, salts: int = 64) -> DataFrame:
    """Two-stage aggregation: per (key, salt), then per key.

    hot: true for rows of heavy keys, which get the salts; spread: what the salt is drawn from. The salt is a hash of
    spread instead of a random draw, so that a task run again after a lost executor sends each row where it went before.
    aggs: the partial aggregates of a salt; merges: the same names made from those partials. Null keys form a group.
    """
    salt = F.when(hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    part = rows.withColumn("__salt", salt).groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in aggs.items()])
    return part.groupBy(*keys).agg(*[c.alias(n) for n, c in merges.items()])


def skew_semi_join(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """left's rows whose key occurs in right (one column, named key), rows of the listed hot keys without a shuffle.

    hot comes from heavy_keys(left, key): its size is bounded, so that right cut down to it may be broadcast.
    """
    if not hot:
        return left.join(right, key, "left_semi")
    few = right.where(F.col(key).isin(hot)).distinct()
    cold = left.where(~F.col(key).isin(hot)).join(right, key, "left_semi")
    return cold.unionByName(left.where(F.col(key).isin(hot)).join(F.broadcast(few), key, "left_semi"))
