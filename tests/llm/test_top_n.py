import random

from loomgraph.llm import top_n as T

SCHEMA = "g long, item long, score long, rank_no string, code string, salt int, part int, c0 int"


def brute(rows, n):
    by = {}
    for g, i, s in {r for r in rows if r[1] is not None and r[2] is not None}:
        by.setdefault(g, []).append((-s, i))
    return {(g, k + 1, i, -s) for g, x in by.items() for k, (s, i) in enumerate(sorted(x)[:n])}


def run(spark, rows, n):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], SCHEMA)
    return {tuple(r) for r in T.top_n(df, ["g"], "score", "item", n).collect()}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "PART", 50)  # so that the large group is salted
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(20), rng.randrange(500), rng.randrange(6) if rng.random() < 0.7 else rng.randrange(10**6)) for _ in range(1500)]
    rows += rows[:50] + [(None, 1, 2), (None, 2, 2), (3, None, 5), (3, 5, None), (7, -4, -9), (7, 2, -9)]
    for n in (1, 3, 40):
        assert run(spark, rows, n) == brute(rows, n)


def test_ties_alone_and_numbers_beyond_a_bigint_code(spark):
    rows = [(1, i, 7) for i in range(100)] + [(2, i, (1 << 60) - i % 3) for i in range(50)] + [(3, -(1 << 40), -5), (3, 1 << 40, -5)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_empty_and_none_wanted(spark):
    assert run(spark, [], 3) == set() and run(spark, [(1, 1, 1)], 0) == set()
