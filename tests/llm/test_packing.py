import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import packing as P


def test_price_is_a_bounded_knapsack():
    got = P.price(np.array([10.0, 6.0, 3.5]), np.array([5, 3, 2]), np.array([1, 5, 1]), 10)
    assert list(got) == [1, 1, 1]
    assert list(P.price(np.array([1.0]), np.array([3]), np.array([9]), 10)) == [3]


def test_solution_covers_all_items_tightly():
    rng = random.Random(1)
    hist = Counter(min(256, int(rng.expovariate(1 / 60)) + 1) for _ in range(30_000))
    plan = P.solve(dict(hist), 256)
    bound = -(-sum(s * n for s, n in hist.items()) // 256)
    assert bound <= plan.containers <= bound * 1.01


@pytest.mark.parametrize("capacity", [2048, 8192])
def test_thousands_of_lengths_in_large_containers(capacity):
    rng = np.random.default_rng(0)
    hist = Counter(np.minimum(np.exp(rng.normal(5, 1.2, 60_000)).astype(int) + 1, capacity).tolist())
    plan = P.solve({int(k): v for k, v in hist.items()}, capacity)
    bound = -(-sum(s * n for s, n in hist.items()) // capacity)
    assert len(hist) > 1500 and bound <= plan.containers <= bound * 1.01


def test_price_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(300):
        m, capacity = int(rng.integers(1, 9)), int(rng.integers(9, 60))
        sizes = rng.permutation(np.arange(1, capacity + 1))[:m]
        limit, weight = rng.integers(0, 5, m), rng.random(m) * sizes
        best = np.full(capacity + 1, 0.0)
        for s, n, w in zip(sizes, limit, weight):
            for _ in range(n):
                best[s:] = np.maximum(best[s:], best[:-s] + w)
        got = P.price(weight, sizes, limit, capacity)
        assert (got <= limit).all() and got @ sizes <= capacity
        assert got @ weight >= best.max() * (1 - 2 * P.PRECISION)


def test_program_uses_no_more_than_there_is():
    sizes, demand = np.array([700, 300, 50, 49, 3]), np.array([900, 1100, 5000, 37, 9000])
    used = P.program(sizes, demand, 1000, np.zeros(5))
    share = used[0][0]
    assert share > 1 and all(sizes[k] @ n <= 1000 for _, k, n in used)
    total = np.zeros(5)
    for x, k, n in used:
        total[k] += x * n
    assert (total <= demand + 1e-6).all()


def test_ranks_beyond_32_bits():
    plan = P.solve({3: 10**14, 7: 5 * 10**13, 10: 10**14}, 10)
    assert plan.container(np.array([10, 10]), np.array([0, 10**14 - 1])).tolist() == [0, 10**14 - 1]
    assert plan.containers == 10**14 + 5 * 10**13 + -(-5 * 10**13 // 3)  # sevens with a three, the other threes by three
    assert plan.container(np.array([3]), np.array([10**14 - 1]))[0] < plan.containers


def run(spark, rows, caps):
    return P.pack(spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, n_tokens long, size_name string, container_id int"), caps).collect()


@pytest.mark.parametrize("ranked", [100_000, 3])
def test_every_item_once_and_no_container_over_full(spark, monkeypatch, ranked):
    monkeypatch.setattr(P, "RANKED", ranked)
    rng = random.Random(2)
    rows = [(i, rng.choice([3, 3, 3, 7, 12, 40, 100, 250])) for i in range(300)] + [(1, 7), (1, 7), (None, 9), (900, 0), (901, None)]
    caps = {"a": 16, "b": 100}
    got = run(spark, rows, caps)
    for name, c in caps.items():
        own = [r for r in got if r["size_name"] == name]
        fill = defaultdict(int)
        for r in own:
            fill[r["container_id"]] += r["n_tokens"]
        assert max(fill.values()) <= c and set(fill) == set(range(max(fill) + 1))
        size = defaultdict(int)
        for r in own:
            size[r["doc_id"]] += r["n_tokens"]
        want = defaultdict(int)
        for i, n in rows:
            want[i] += n or 0
        assert size == want
        whole = Counter((i, n or 0) for i, n in rows if (n or 0) <= c)
        assert Counter((r["doc_id"], r["n_tokens"]) for r in own if (r["doc_id"], r["n_tokens"]) in whole) >= whole  # only longer items are divided
        assert len(own) == sum(max(1, -(-(n or 0) // c)) for _, n in rows)


def test_empty_and_bad_capacity(spark):
    assert run(spark, [], {"a": 5}) == []
    with pytest.raises(ValueError):
        run(spark, [(1, 1)], {"a": 0})
