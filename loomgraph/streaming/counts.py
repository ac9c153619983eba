"""Surface counts kept up to date from a stream of slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_counts(slots: DataFrame, time: str = "counted_at", late: str = "30 days", window: str = "1 day") -> DataFrame:
    """(window, trie_index, entity, n, cnt) of a stream (or table) of slots.

    Repeated deliveries are dropped within the watermark, which also bounds the state; slots later than that are left out, as
    their window has been closed. Null times, entities and counts give no row.
    """
    rows = slots.where(F.col(time).isNotNull() & (F.col("trie_index2indices_values") >= 0) & F.col("trie_index2indices_counts").isNotNull())
    if rows.isStreaming:
        rows = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["slot_id"])
    else:
        rows = rows.dropDuplicates(["slot_id"])
    key = [F.window(time, window).alias("window"), "trie_index", F.col("trie_index2indices_values").alias("entity")]
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("trie_index2indices_counts").alias("cnt"))
