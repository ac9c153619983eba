"""Problem 3: the N highest-scoring items of every group, by simultaneous bisection of all groups' cutoffs.

An item's code orders first by score (higher is better), then by identifier (smaller is better), and is one whole number.
For every group the code of its N-th item is searched: the range that holds it is cut at midpoints, the rows above each are
counted, and the range shrinks to the part in which the N-th lies, until exactly N rows stand at or above it. All groups
move together, a round of them is one aggregation, and a round cuts at WAYS - 1 midpoints at once, which saves
log2(WAYS) - 1 of log2(WAYS) rounds. No group is sorted or gathered anywhere, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph import storage

#: Parts into which a round cuts a group's range.
WAYS = 64
#: Rows of a group in one part of the join with the cutoffs; larger groups are spread by a salt.
PART = 50_000
MOST_ROUNDS = 200


def _codes(rows: DataFrame, score: str, item: str) -> tuple[DataFrame, int, int]:
    """rows with their code, and what turns it back into (score, item): the highest item, and the number of items' codes.

    The code is a bigint where the ranges of score and item allow it, else a decimal of 38 digits: both are exact.
    """
    r = rows.agg(F.min(score).alias("s0"), F.max(score).alias("s1"), F.min(item).alias("i0"), F.max(item).alias("i1")).first()
    if r["s0"] is None:
        return rows.withColumn("code", F.lit(0).cast("long")), 0, 1
    span = r["i1"] - r["i0"] + 1
    kind = "bigint" if (max(abs(r["s0"]), abs(r["s1"])) + 1) * span < 1 << 62 else "decimal(38,0)"
    code = F.col(score).cast(kind) * F.lit(span).cast(kind) + (F.lit(r["i1"]).cast(kind) - F.col(item).cast(kind))
    return rows.withColumn("code", code.cast(kind)), r["i1"], span


def top_n(df: DataFrame, groups: list[str], score: str, item: str, n: int) -> DataFrame:
    """(groups, rank_no int, item, score) of the n rows with the highest score in every group; equal scores go to the smaller item first.

    score and item are whole numbers. Rows whose score or item is null are no items and are left out. Null groups are
    groups of their own. Rows equal in group, score and item count once; an item with several scores stands once for each.
    Groups with n items or fewer come out whole. Further columns are ignored, whatever their names; an empty table or n = 0 gives no rows.
    """
    names = [f"g{i}" for i in range(len(groups))]
    kind_of = dict(df.dtypes)
    rows = df.select(*[F.col(g).alias(a) for g, a in zip(groups, names, strict=True)], F.col(score).cast("long").alias("s"), F.col(item).cast("long").alias("i"))
    rows = rows.where("s is not null and i is not null").distinct()
    rows = storage.cut(rows, "top-rows")
    rows, highest, span = _codes(rows, "s", "i")
    chosen = _bisect(rows.select(*names, "code"), names, n)
    kind = dict(chosen.dtypes)["code"]
    w = W.partitionBy(*names).orderBy(F.desc("code"))
    # floor division brings score and item back; pmod keeps the item right for negative scores
    rest = F.pmod(F.col("code"), F.lit(span).cast(kind))
    out = chosen.select(*names, F.row_number().over(w).alias("rank_no"), "code", rest.alias("rest"))
    out = out.select(*names, "rank_no", (F.lit(highest) - F.col("rest")).cast(kind_of[item]).alias("i"), F.expr(f"(code - rest) div {span}").alias("s"))
    return out.select(*[F.col(a).alias(g) for g, a in zip(groups, names, strict=True)], "rank_no", F.col("i").alias(item), F.col("s").cast("long").alias(score))


def _bisect(rows: DataFrame, names: list[str], n: int) -> DataFrame:
    """The n rows of highest code of every group; codes are distinct within a group."""
    if n < 1:
        return rows.limit(0)
    state = rows.groupBy(*names).agg(F.count("*").alias("c"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    state = storage.cut(state.withColumn("want", F.lit(n).cast("long")), "top-groups")
    # Rows of a large group draw one of as many salts as it has parts of `part` rows, so that the joins with its range are
    # spread. There are at most 10,000 such groups, which is what is broadcast.
    part = max(PART, (state.agg(F.sum("c")).first()[0] or 0) // 10_000)
    state = state.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("c") / part)).cast("int"))
    wide = F.broadcast(state.where(F.col("c") > part).select(*names, "parts"))
    salt = F.coalesce(F.pmod(F.xxhash64("l.code"), F.col("r.parts")), F.lit(0)).cast("int")
    group = [F.col(f"l.{g}").alias(g) for g in names]
    same = _all([F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in names])
    live = rows.alias("l").join(wide.alias("r"), same, "left").select(*group, "l.code", salt.alias("salt"), F.lit(0).alias("part"))
    # state has a row for each group in play: its part `at` holds the N-th row, is `c` rows large and spans lo to hi
    state, taken = state.withColumn("at", F.lit(0)), []
    for _ in range(MOST_ROUNDS):
        ranges = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        whole = (F.col("l.part") > F.col("r.at")) | (F.col("r.c") <= F.col("r.want"))
        cut = F.expr(f"cast((l.code - r.lo) div ((r.hi - r.lo) div {WAYS} + 1) as int)")
        joined = live.alias("l").join(ranges.alias("r"), same & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.part") >= F.col("r.at")))
        joined = storage.cut(joined.select(*group, "l.code", "l.salt", whole.alias("taken"), F.when(~whole, cut).alias("part"), "r.want", "r.parts"), "top-live")
        taken.append(joined.where("taken").select(*names, "code"))
        live = joined.where("not taken")
        # the rows of each part between two midpoints; summed up from above they are the rows above a midpoint
        counts = live.groupBy(*names, "part").agg(F.count("*").alias("c"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.first("want").alias("n"), F.first("parts").alias("parts"))
        above = F.sum("c").over(W.partitionBy(*names).orderBy(F.desc("part"))) - F.col("c")  # at most WAYS rows for a group
        counts = counts.withColumn("above", above).withColumn("want", F.col("n") - F.col("above"))
        state = storage.cut(counts.where("want > 0 and want <= c").select(*names, "c", "lo", "hi", "want", "parts", F.col("part").alias("at")), "top-groups")
        if state.isEmpty():
            out = taken[0]
            for t in taken[1:]:
                out = out.unionByName(t)
            return out
        live = live.select(*names, "code", "salt", "part")
    raise RuntimeError("the cutoffs didn't settle")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
