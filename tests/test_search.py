"""Type search: to its end, over all types, with scores as by hand."""

import itertools

import oracle_check
from loomgraph.operators.search import Search
from loomgraph.plans import registry


def ladder(spark, n: int) -> Search:
    """n surfaces whose truth is second to another candidate, each told apart by a type of its own."""
    dictionary = spark.createDataFrame([(i, c, k) for i in range(n) for c, k in ((2 * i, 9), (2 * i + 1, 4))], "surface_id long, entity long, cnt long")
    mentions = spark.createDataFrame([(i, 2 * i + 1, i + 1) for i in range(n)], "surface_id long, entity long, n long")
    return Search(mentions, dictionary, spark.createDataFrame([(2 * i + 1, 100 + i) for i in range(n)], "entity long, type long"), penalty=0.0001)


def test_search_ends_only_when_all_have_stopped(spark):
    search = ladder(spark, 22)
    assert [r["type"] for r in search.solve(1).orderBy("place").collect()] == list(range(100, 122))
    assert search.solve(1, 3).count() == 3


def test_gains_by_hand(spark):
    rows = {1: [(10, 9, 0), (11, 7, 5), (12, 7, 3)], 2: [(11, 4, 0), (13, 4, 2), (10, 3, 8)], 3: [(14, 6, 1), (10, 5, 1)]}
    types = {10: {1}, 11: {2, 3}, 12: {2}, 13: {1, 3}}
    dictionary = spark.createDataFrame([(s, e, c) for s, x in rows.items() for e, c, _ in x], "surface_id long, entity long, cnt long")
    mentions = spark.createDataFrame([(s, e, n) for s, x in rows.items() for e, _, n in x if n], "surface_id long, entity long, n long")
    sets = [c for k in range(4) for c in itertools.combinations((1, 2, 3), k)]
    want = {}
    for k, picks in enumerate(sets):
        of = lambda e: types.get(e, set()) & set(picks)
        want[k] = sum(n for x in rows.values() for place, (e, _, n) in enumerate(x) if place and all(of(o) != of(e) for o, *_ in x[:place]))
    search = Search(mentions, dictionary, spark.createDataFrame([(e, t) for e, ts in types.items() for t in ts], "entity long, type long"))
    assert search.gains(sets) == want


def test_rounds_score_all_types(spark, sf_dir):
    con = oracle_check.connect(sf_dir)
    for name in ("beam_round", "type_objective"):
        said = oracle_check.compare(spark, con, name, sf_dir, registry.queries()[name], registry.oracle_sql()[name])
        assert said.startswith("ok"), said
