"""Hand-worked cases of the engine's own operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import classify as C
from loomgraph.operators import metrics as E
from loomgraph.operators import repair as L
from loomgraph.operators import sequences as S
from loomgraph.operators.graph import Rule, TypeGraph


def one(spark, build, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(build(F.col("x"))).collect()]


def test_scalars(spark):
    assert one(spark, X.parse_year, "+1950-01-01T00:00:00Z", "-0500-01-01", "", None) == [1950, -500, None, None]
    assert one(spark, X.clean_surface, "(The Eiffel Tower)", "dog's", "hi!", "L'Oise", "the", None, "") == ["eiffel tower", "dog", "", "oise", "", None, ""]
    assert one(spark, X.acceptable_surface, "1990", "3rd", "1/2", "", "2nd street", None) == [False, False, False, False, True, False]
    assert one(spark, X.name_alternates, "A (b)", "Crises", "Cities", "Cats", "Dog") == [["A (b)", "A"], ["Crises", "Crisis"], ["Cities", "City"], ["Cats", "Cat"], ["Dog"]]
    assert one(spark, X.clean_title, "new_York#x", "éa", "") == ["New York", "Éa", ""]
    links = one(spark, X.anchors, "[[A#s|b]] [[A]] [[A|]] [[File:x]] [[a|b|c]]")[0]
    assert [tuple(x) for x in links] == [("b", "A"), ("A", "A"), ("c", "a|b")]
    assert one(spark, X.redirect, "#REDIRECT [[X]]", "#redirect[[X|y]]", "#REDIRECTION [[X]]") == ["X", "X", None]


def edges(spark, rows):
    return spark.createDataFrame([(p, c, q, 0) for p, c, q in rows], "prop string, child long, parent long, pos int")


def members(df):
    return sorted(r["entity"] for r in df.collect())


def test_closure_rules(spark):
    e = edges(spark, [("P", 2, 1), ("P", 3, 2), ("P", 1, 3), ("Q", 4, 3), ("P", 5, 4)])
    g = TypeGraph(e)
    assert members(g.satisfy(["P"], [1])) == [1, 2, 3]  # a cycle ends
    assert members(g.satisfy(["P", "Q"], [1])) == [1, 2, 3, 4, 5]
    assert members(g.satisfy(["P", "Q"], [1], 1)) == [1, 2]
    assert members(g.satisfy(["P"], [])) == []
    with pytest.raises(ValueError):
        g.satisfy([], [1])
    bad = spark.createDataFrame([(3,)], "entity long")
    assert members(TypeGraph(e, bad).satisfy(["P", "Q"], [1])) == [1, 2]  # a forbidden node isn't crossed
    assert members(TypeGraph(e, bad).satisfy(["P", "Q"], [3])) == [1, 2, 4, 5]  # a forbidden seed is expanded, but no member
    pair = spark.createDataFrame([(3, 2)], "child long, parent long")
    assert members(TypeGraph(e, None, pair).satisfy(["P", "Q"], [1])) == [1, 2]
    got = g.closures([Rule(1, ("P",), (4,)), Rule(2, ("P", "Q"), (1,), 2)])
    assert sorted(map(tuple, got.collect())) == [(1, 4), (1, 5), (2, 1), (2, 2), (2, 3)]
    path = {r["entity"]: r["path"] for r in g.connection_path(["P", "Q"], spark.createDataFrame([(5,), (9,)], "entity long"), 1).collect()}
    assert path == {5: ["5", "P", "4", "Q", "3", "P", "2", "P", "1"]}
    assert sorted(map(tuple, g.path_reach(spark.createDataFrame([(5,)], "entity long"), [("P", 1), ("Q", 1), ("P", 2)]).collect())) == [(5, 1), (5, 2)]


def test_connection_path_of_any_depth(spark):
    g = TypeGraph(edges(spark, [("P", i + 1, i) for i in range(1, 40)] + [("P", 1, 40)]))  # a cycle
    asked = spark.createDataFrame([(40,), (3,)], "entity long")
    got = {r["entity"]: r["path"] for r in g.connection_path(["P"], asked, 1).collect()}
    assert {e: len(p) for e, p in got.items()} == {40: 2 * 39 + 1, 3: 2 * 2 + 1}
    assert got[40][:3] == ["40", "P", "39"]
    assert [r["entity"] for r in g.connection_path(["P"], asked, 1, 2).collect()] == [3]


def test_export_takes_the_later_name(spark):
    s = lambda *x: spark.createDataFrame([(i,) for i in x], "entity long")
    got = {tuple(r) for r in C.export(s(1, 2, 3), {"a": s(), "b": s(1), "c": s(1, 2)}).collect()}
    assert got == {(1, 2, "c"), (2, 2, "c"), (3, 3, "other")}
    assert C.other(s(1)) is None
    with pytest.raises(ValueError):
        C.any_of()


def test_repair_rules(spark):
    rows = L.start(spark.createDataFrame([(1, 10, 3), (1, 20, 9), (2, 10, 3), (2, 20, 5), (3, 10, 9), (3, 20, 9)], "surface_id long, entity long, cnt long"))
    got = {(r["surface_id"], r["old_entity"]): r["entity"] for r in L.promote(rows, F.col("entity") == 10, F.col("entity") == 20).collect()}
    assert got == {(1, 10): 20, (1, 20): 20, (2, 10): None, (2, 20): 20, (3, 10): 10, (3, 20): 20}
    pairs = spark.createDataFrame([(64, 51), (63, 51), (10, 11), (60, 50)], "a long, b long")
    assert [r[0] for r in pairs.select(L.keep_high(F.col("a"), F.col("b"))).collect()] == [False, True, True, False]
    first = spark.createDataFrame([(1, 1, 2), (1, 3, None)], "surface_id long, old_entity long, new_entity long")
    second = spark.createDataFrame([(1, 2, 5)], "surface_id long, old_entity long, new_entity long")
    assert {tuple(r) for r in L.compose(first, second).collect()} == {(1, 1, 5), (1, 3, None)}


def test_sequences(spark):
    lines = spark.createDataFrame([(1, i) for i in (1, 4, 20)], "d long, p long")
    assert [r["group_no"] for r in S.gap_groups(lines, "d", "p", F.lit(True), 5).orderBy("p").collect()] == [1, 1, 2]
    packed = S.pack_batches(spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "d long, n long").coalesce(1), "d", "n", 10, 2)
    assert [r["batch"] for r in packed.orderBy("d").collect()] == [0, 1, 2]  # 20 < 20 is false
    t = spark.createDataFrame([(1, i, str(i)) for i in range(10)], "d long, p long, t string")
    assert [(r["p"], r["window"][0], r["window"][-1]) for r in S.sliding(t, "d", "p", "t", 3).orderBy("p").collect()] == [(3, "0", "5"), (4, "1", "6"), (5, "2", "7"), (6, "3", "8")]  # 7 is not below 10 - 3


def test_metrics(spark):
    conf = spark.createDataFrame([(0, 0, 0, 5), (1, 5, 0, 0)], "class int, tp long, fp long, fn long")
    assert tuple(E.weighted_f1(conf).first()) == (50.0, 50.0, 50.0)
    assert E.viterbi(np.array([[1, 0], [0, 0.5], [1, 0]]), np.eye(2))[0] == [0, 0, 0]
    assert E.viterbi(np.zeros((0, 2)), np.eye(2)) == ([], 0.0)
