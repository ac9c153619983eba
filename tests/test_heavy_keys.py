from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomgraph.operators import heavy_keys, skew

SCHEMA = "slot_id long, trie_index long, surface string, trie_index2indices_values int, trie_index2indices_counts long, shard int, n_slots long, key_id long"


def slots(spark, rows):
    return spark.createDataFrame([(*r, 1, 7, 7) for r in rows], SCHEMA)  # with columns named as results are


def brute(rows):
    n, s = Counter(), defaultdict(int)
    for slot, trie, ent, cnt in {(r[0], r[1], r[3], r[4]) for r in rows if r[0] is not None}:
        for k in [("surface", trie)] + ([("entity", ent)] if ent is not None and ent >= 0 else []):
            n[k] += 1
            s[k] += cnt or 0
    return {(*k, v, s[k]) for k, v in n.items()}


def test_totals_equal_brute_force_with_hot_keys_repeats_and_nulls(spark):
    rows = [(i, 1 if i % 3 else i, f"s{i}", None if i % 11 == 0 else (-1 if i % 7 == 0 else i % 5), None if i % 13 == 0 else i % 4) for i in range(3000)]
    rows += [(r[0], r[1], "other spelling", r[3], r[4]) for r in rows[::4]] + [(None, 5, "x", 1, 1), (9000, None, None, None, None)]
    got = heavy_keys.key_totals(slots(spark, rows))
    assert {tuple(r) for r in got.collect()} == brute(rows)
    found = heavy_keys.found(got)
    total = len({r[0] for r in rows if r[0] is not None})
    assert {tuple(r) for r in found.collect()} == {(k, i) for k, i, n, _ in brute(rows) if n * 100 >= total and i is not None}


def test_empty(spark):
    t = heavy_keys.key_totals(slots(spark, []))
    assert t.count() == 0 and heavy_keys.found(t).count() == 0


def test_heavy_keys_and_skew_join(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("a").alias("v"))
    assert skew.heavy_keys(df, F.col("k"), 0.01) == [7]
    right = spark.createDataFrame([(7,), (8,), (8,), (None,)], "k long")
    got = skew.skew_semi_join(df, right, "k", [7])
    assert Counter(r["k"] for r in got.collect()) == Counter({7: 1668, 8: 1})  # the id 7 itself too
    assert skew.heavy_keys(df.limit(0), F.col("k")) == []
