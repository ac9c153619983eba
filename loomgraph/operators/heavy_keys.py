"""Problem 1: per-key results although a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import heavy_keys, salted_totals

SLOT, SURFACE, ENTITY, COUNT = "slot_id", "trie_index", "trie_index2indices_values", "trie_index2indices_counts"


def distinct_slots(slots: DataFrame) -> DataFrame:
    """Each slot_id once, as (slot_id, trie_index, entity, cnt).

    Deliveries of one slot agree on these three, so that any of them will do; max() keeps the aggregation on fixed-width
    buffers. slot_id is unique but for repeated deliveries, so this shuffle has no hot key. Rows without a slot_id can't
    be told from repeats and are left out.
    """
    return (
        slots.select(SLOT, SURFACE, ENTITY, COUNT)
        .where(F.col(SLOT).isNotNull())
        .groupBy(SLOT)
        .agg(F.max(SURFACE).alias("trie_index"), F.max(F.col(ENTITY).cast("long")).alias("entity"), F.max(F.col(COUNT).cast("long")).alias("cnt"))
    )


def key_totals(slots: DataFrame, least_share: float = 0.002, salts: int = 64) -> DataFrame:
    """(key_kind, key_id, n_slots, sum_counts): for every surface and every entity, over slots taken once.

    Two-stage salted aggregation. Heavy surfaces and entities are found by a sketch over the raw rows, whatever their
    number of repeats; their slots get one of `salts` salts, partial results are made for each salt and merged by key.
    Null and negative entities are no entities; a null trie_index makes one row with key_id null, so that the n_slots of the
    surfaces add up to all slots. Null counts add nothing; a key with only null counts has sum_counts 0. An empty
    table gives no rows.
    """
    # one number for both kinds of keys, as the sketch takes plain values: surfaces are even, entities odd
    coded = slots.select(F.explode(F.array(F.col(SURFACE).cast("long") * 2, F.when(F.col(ENTITY) >= 0, F.col(ENTITY).cast("long") * 2 + 1))).alias("code"))
    hot = heavy_keys(coded, F.col("code"), least_share)
    pairs = F.array(
        F.struct(F.lit("surface").alias("key_kind"), F.col("trie_index").alias("key_id")),
        F.struct(F.lit("entity").alias("key_kind"), F.col("entity").alias("key_id")),
    )
    rows = (
        distinct_slots(slots)
        .select("slot_id", "cnt", F.explode(pairs).alias("k"))
        .select("slot_id", "cnt", "k.key_kind", "k.key_id")
        .where((F.col("key_kind") == "surface") | (F.col("key_id") >= 0))
    )
    code = F.col("key_id") * 2 + (F.col("key_kind") == "entity").cast("long")
    return salted_totals(
        rows,
        ["key_kind", "key_id"],
        {"n": F.count("*"), "s": F.sum("cnt")},
        {"n_slots": F.sum("n"), "sum_counts": F.coalesce(F.sum("s"), F.lit(0)).cast("long")},
        F.coalesce(code.isin(hot), F.lit(False)) if hot else F.lit(False),
        F.col("slot_id"),
        salts,
    )


def found(totals: DataFrame, one_in: int = 100) -> DataFrame:
    """(key_kind, key_id) of the keys with at least one in one_in of all slots; totals as from key_totals, already written."""
    all_slots = totals.where("key_kind = 'surface'").agg(F.sum("n_slots"))
    return totals.where(F.col("key_id").isNotNull() & (F.col("n_slots") * one_in >= all_slots.scalar())).select("key_kind", "key_id")
