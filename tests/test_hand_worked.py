"""Cases whose result is worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import classify as C
from loomgraph.operators import graph as G
from loomgraph.operators import links as K
from loomgraph.operators import metrics as E
from loomgraph.operators import ranks
from loomgraph.operators import repair as L
from loomgraph.operators import sequences as S
from loomgraph.operators.search import solution_configs


def of(spark, fn, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r["y"] for r in df.select("k", fn(F.col("x")).alias("y")).orderBy("k").collect()]


def test_scalar_functions(spark):
    assert of(spark, X.parse_year, "+1950-01-01T00:00:00Z", "-0500-01-01", "x", None) == [1950, -500, None, None]
    links = of(spark, X.anchors, "[[A#s|b]]", "[[A]]", "[[A|]]", "[[File:x]]", "[[a|b|c]]", "[[ A b ]]")
    assert [[(a["anchor"], a["target"]) for a in x] for x in links] == [[("b", "A")], [("A", "A")], [], [], [("c", "a|b")], [("A b", "A b")]]
    assert of(spark, X.redirect, "#REDIRECT [[X]]", "#redirect[[X|y]]", "#REDIRECTION [[X]]", "REDIRECIONAMENTO [[X#s]]", "#redirección [[É]]") == ["X", "X", None, "X", "É"]
    assert of(spark, X.clean_surface, "(The Eiffel Tower)", "dog's", "hi!", "L'Oise", "the", "into the wild", "or", "Ludwig von B", "p. 5", "dogs'", "") == ["eiffel tower", "dog", "", "oise", "", "wild", "or", "ludwig von b", "5", "", ""]
    assert of(spark, X.acceptable_surface, "1990", "3rd", "1/2", "", "2nd street") == [False, False, False, False, True]
    assert of(spark, X.name_alternates, "A (b)", "Crises", "Cities", "Cats", "A") == [["A (b)", "A"], ["Crises", "Crisis"], ["Cities", "City"], ["Cats", "Cat"], ["A"]]
    assert of(spark, X.categories, "[[Category:A#x|b]] [[Kategorie:B#y]] [[Image:c]]") == [["Category:A", "Kategorie:B#y"]]
    assert of(spark, lambda c: X.byte_codes(c, 6), "é", "abcdefg", "") == [[255, 195, 169, 256, -1, -1], [255, *range(97, 104), 256], [255, 256, -1, -1, -1, -1]]


def test_titles_resolve_in_three_steps(spark):
    titles = spark.createDataFrame([("w", "A", 1), ("w", "New York", 2), ("w", "B", 3)], "wiki string, title string, entity long")
    redirects = spark.createDataFrame([("w", "Alias", "b"), ("w", "Twice", "Alias")], "wiki string, source string, target string")
    asked = spark.createDataFrame([("w", t) for t in ("A", "new_York#x", "alias", "twice", "none")], "wiki string, target string")
    assert {r["target"]: r["entity"] for r in K.resolve(asked, titles, redirects).collect()} == {"A": 1, "new_York#x": 2, "alias": 3, "twice": -1, "none": -1}


def test_counting_links(spark):
    titles = spark.createDataFrame([("w", "A", 1), ("w", "P", 7)], "wiki string, title string, entity long")
    none = spark.createDataFrame([], "wiki string, source string, target string")
    lines = [("w", "P", "the Cat", "A"), ("w", "P", "the Cat", "A"), ("w", "Nowhere", "Cat", "A"), ("w", "P", "x", "Unknown"), ("w", "P", "the", "A"), ("w", "z" * 257, "Cat", "A"), ("w", "P", "y" * 254, "A")]
    got = K.resolved_lines(spark.createDataFrame(lines, "wiki string, context string, anchor string, target string"), titles, none)
    assert [tuple(r) for r in K.surface_counts(got).collect()] == [("cat", 1, 3)]
    assert sorted(tuple(r) for r in K.surface_counts(got, "context").collect()) == [("cat", -1, 1), ("cat", 7, 2)]
    assert [r["surface"] for r in K.vocabulary(got).collect()] == ["cat"]
    assert tuple(K.diagnostics(got).first()) == (5, 1, 1, "w/Unknown")


def test_tags(spark):
    dictionary = spark.createDataFrame([("cat", 1, 9), ("cat", 2, 1), ("12", 3, 5), ("dog", 4, 5)], "surface string, entity long, cnt long")
    links = spark.createDataFrame([(0, 0, "cat", 1), (0, 1, "cat", 2), (0, 2, "12", 3), (0, 3, "cat", -1), (0, 4, "", 1), (0, 5, "dog", 4)], "doc long, pos int, surface string, entity long")
    tags = lambda **k: [r["entity"] for r in K.obtain_tags(links, dictionary, **k).orderBy("pos").collect()]
    assert tags() == [1, 2, None, None, None, 4]
    assert tags(min_percent=20) == [1, None, None, None, None, 4] and tags(min_count=6) == [1, None, None, None, None, None]
    assert tags(blacklist=spark.createDataFrame([("dog",)], "surface string")) == [1, 2, None, None, None, None]
    moves = spark.createDataFrame([("cat", 2, 1), ("cat", 1, 1), ("dog", 4, None)], "surface string, old_entity long, entity long")
    left = spark.createDataFrame([("cat", 1, 10)], "surface string, entity long, cnt long")
    assert tags(transitions=moves, repaired=left) == [1, 1, None, None, None, None]


def edges(spark, *rows):
    return spark.createDataFrame([("P", c, p, 0) for c, p in rows], "prop string, child long, parent long, pos int")


def reached(graph, seeds, steps=None):
    return sorted(r["entity"] for r in graph.satisfy(["P"], seeds, steps).collect())


def test_closures(spark):
    cycle = edges(spark, (2, 1), (1, 2), (3, 2), (4, 3), (5, 1))
    node = lambda *k: spark.createDataFrame([(x,) for x in k], "entity long")
    assert reached(G.TypeGraph(cycle), [1]) == [1, 2, 3, 4, 5] and reached(G.TypeGraph(cycle), [1], 1) == [1, 2, 5] and reached(G.TypeGraph(cycle), []) == []
    assert reached(G.TypeGraph(cycle, node(3)), [1]) == [1, 2, 5]  # a forbidden node in between blocks
    assert reached(G.TypeGraph(cycle, node(1)), [1]) == [2, 3, 4, 5]  # a forbidden seed is expanded, but absent
    pairs = spark.createDataFrame([(3, 2)], "child long, parent long")
    assert reached(G.TypeGraph(cycle, None, pairs), [1]) == [1, 2, 5]
    assert reached(G.TypeGraph(cycle.union(edges(spark, (3, 5))), None, pairs), [1]) == [1, 2, 3, 4, 5]  # another route stays open
    with pytest.raises(ValueError):
        G.TypeGraph(cycle).satisfy([], [1])


def test_closure_cache_and_connections(spark):
    cache = G.ClosureCache(G.TypeGraph(edges(spark, (2, 1), (3, 2))), 2)
    a = cache.satisfy(["P"], [1])
    assert cache.satisfy(["P"], [1]) is a and a.count() == 3
    cache.satisfy(["P"], [2]), cache.satisfy(["P"], [3])
    assert len(cache.kept) == 2 and cache.satisfy(["P"], [1]) is a
    cache.forbid(spark.createDataFrame([(2,)], "entity long"), None)
    assert not cache.kept and sorted(r["entity"] for r in cache.satisfy(["P"], [1]).collect()) == [1]
    ids = spark.createDataFrame([(1, "Q1"), (3, "Q3")], "entity long, qid string")
    names = spark.createDataFrame([(1, "root"), (2, "middle")], "entity long, name string")
    graph = G.TypeGraph(edges(spark, (2, 1), (3, 2)))
    assert G.describe_connection(graph, ids, names, "Q3", "root", ["P"]) == "#3 -P-> middle -P-> root"
    assert G.describe_connection(graph, ids, names, "root", "Q3", ["P"]) is None
    with pytest.raises(ValueError):
        G.describe_connection(graph, ids, names, "Q9", "root", ["P"])


def test_repair_rules(spark):
    def promoted(*rows, keep_min=5):
        df = spark.createDataFrame([(1, e, c, e) for e, c, *_ in rows], "surface_id long, old_entity long, cnt long, entity long")
        cond, alt = ({e for e, _, k in rows if k == x} for x in ("cond", "alt"))
        return {r["old_entity"]: r["entity"] for r in L.promote(df, F.col("entity").isin(*cond), F.col("entity").isin(*alt), keep_min).collect()}

    assert promoted((1, 3, "cond"), (2, 9, "alt")) == {1: 2, 2: 2}
    assert promoted((1, 3, "cond"), (2, 5, "alt")) == {1: None, 2: 2}
    assert promoted((1, 9, "cond"), (2, 9, "alt")) == {1: 1, 2: 2}
    pairs = spark.createDataFrame([(64, 51), (63, 51), (10, 11), (60, 50)], "o long, n long").select(L.keep_high(F.col("o"), F.col("n")).alias("k")).collect()
    assert [r["k"] for r in pairs] == [False, True, True, False]
    rows = spark.createDataFrame([(1, 7, 3, 7), (1, 8, 1, 8), (1, 9, 2, 7), (1, 5, 9, None)], "surface_id long, old_entity long, cnt long, entity long")
    assert {(r["entity"], r["cnt"]) for r in L.reduce_values(rows).collect()} == {(7, 5), (8, 1)}


def test_classes(spark):
    every = spark.createDataFrame([(k,) for k in (1, 2, 3)], "entity long")
    pick = lambda *k: spark.createDataFrame([(x,) for x in k], "entity long")
    assert {r["entity"]: r["label"] for r in C.export(every, {"a": pick(1), "b": pick(1, 2), "c": pick(2)}).collect()} == {1: "b", 2: "c", 3: "other"}
    years = spark.createDataFrame([(None,), (1900,)], "y int").select(C.compare(F.col("y"), "<", 1950).alias("a"), (~C.compare(F.col("y"), "<", 1950)).alias("b")).collect()
    assert [tuple(r) for r in years] == [(False, True), (True, False)]
    graph = G.TypeGraph(edges(spark, (2, 1), (3, 2), (3, 9), (4, 9)))
    sets = C.by_rules(graph, [G.Rule(0, ("P",), (1,)), G.Rule(1, ("P",), (9,))], {0: "one", 1: "nine"}, [C.ClassRule("x", ("one",)), C.ClassRule("y", ("nine",), ("x",)), C.ClassRule("z", ("one", "nine"))])
    assert {n: sorted(r["entity"] for r in s.collect()) for n, s in sets.items()} == {"x": [1, 2, 3], "y": [4, 9], "z": [1, 2, 3, 4, 9]}
    members = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (2, 7)], "rule_id int, entity long")
    assert [tuple(r) for r in C.truth_table(members, pick(1, 2)).collect()] == [(1, 1)]


def test_labels_join_or_fail(spark):
    ids = spark.createDataFrame([(1, "Q1")], "entity long, qid string")
    classes = {"k": spark.createDataFrame([(1, 4)], "entity long, class_id int")}
    labels = lambda *q: spark.createDataFrame([(k, x) for k, x in enumerate(q)], "n int, qid string")
    assert [r["k"] for r in C.label_classes(labels("Q1", "", None, " "), ids, classes).orderBy("n").collect()] == [4, None, None, None]
    with pytest.raises(Exception, match="unknown label: Q5"):
        C.label_classes(labels("Q5"), ids, classes).collect()


def lines(spark, *tokens):
    return spark.createDataFrame([(0, k, t) for k, t in enumerate(tokens)], "doc long, pos int, token string")


def test_groups_and_windows(spark):
    own = lines(spark, *["x" if k not in (1, 4, 20) else "L" for k in range(25)])
    groups = S.gap_groups(own, "doc", "pos", F.col("token") == "L", 5)
    assert sorted((r["pos"], r["group_no"]) for r in groups.collect()) == [(1, 1), (4, 1), (20, 2)]
    text = lines(spark, "a", "", "b", "L", "c", "", "d", "L")
    blank = F.col("token") == ""
    groups = S.gap_groups(S.with_blanks(text, "doc", "pos", blank), "doc", "pos", F.col("token") == "L", 9, blank)
    got = S.context(text, groups, "doc", "pos", 5)
    by = {g: [r["token"] for r in got.where(F.col("group_no") == g).orderBy("pos").collect()] for g in (1, 2)}
    assert by == {1: ["", "b", "L", "c"], 2: ["", "d", "L"]}  # the blank before belongs to it, the one after ends it
    for label, want in ((2, None), (3, [0, 1, 2, 3, 4, 5]), (7, None), (6, [3, 4, 5, 6, 7, 8])):
        w = {r["pos"]: r["window"] for r in S.sliding(lines(spark, *map(str, range(10))), "doc", "pos", "token", 3).collect()}
        assert w.get(label) == (want if want is None else [str(x) for x in want])


def test_retokenized_labels(spark):
    words = spark.createDataFrame([(0, 0, 5, True), (0, 6, 9, False)], "doc long, start long, end long, label boolean")
    tokens = spark.createDataFrame([(0, 0, "New", 3), (0, 1, "-y", 5), (0, 2, "abc", 9)], "doc long, pos int, token string, end long")
    assert [r["label"] for r in S.retokenize(words, tokens, "doc").orderBy("pos").collect()] == [True, True, False]


def test_deltas_and_ranks(spark):
    rows = spark.createDataFrame([(k,) for k in (3, 5, 200_000, 200_001, 10**12)], "n long")
    deltas = S.delta_encode(rows, "n")
    assert {r["n"]: r["delta"] for r in deltas.collect()} == {3: 3, 5: 2, 200_000: 199_995, 200_001: 1, 10**12: 10**12 - 200_001}
    placed = spark.createDataFrame([(0, 3), (1, 2), (2, 199_995)], "place long, delta long")
    assert [r["number"] for r in S.delta_decode(placed, "place", span=2).orderBy("place").collect()] == [3, 5, 200_000]
    df = spark.createDataFrame([(g, k % 3, k) for g in "ab" for k in range(50)], "g string, v int, k long")
    ranked = ranks.rank_in_order(df, ["g"], [-F.col("v")], "k", [], 7).collect()
    for g in "ab":
        assert [r["k"] for r in sorted((r for r in ranked if r["g"] == g), key=lambda r: r["rank"])] == sorted(range(50), key=lambda k: (-(k % 3), k))
    top = ranks.top_k(df, ["g"], [F.desc("v"), F.col("k")], 3, "k").where("g = 'a'").orderBy("k_no").collect()
    assert [(r["k_no"], r["k"]) for r in top] == [(1, 2), (2, 5), (3, 8)]
    split = {r["k"]: r["part"] for r in S.ordered_split(df.where("g = 'a'"), "g", "k", 0.8).collect()}
    assert [k for k, p in split.items() if p == "dev"] and sorted(k for k, p in split.items() if p == "dev") == list(range(40, 50))


def test_draws_are_repeatable_and_keep_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = ([tuple(r) for r in S.shuffled(df, "k", 100, 1).orderBy("chunk_order", "place").collect()] for _ in range(2))
    assert a == b and sorted(r[0] for r in a) == list(range(1000)) and [r[0] for r in a] != list(range(1000))
    mixed = S.mix({"x": df, "y": df.limit(10)}, "k").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in mixed} == {"x": 1000, "y": 10}
    tokens = spark.createDataFrame([(k, 0, "Dogs") for k in range(400)], "doc long, pos int, token string")
    got = [r["dropped"] for r in S.dropout(tokens, "doc", "pos", "token", 0.5, 0.5, 0.2).collect()]
    assert set(got) == {"Dogs", "dogs", "Dog", "dog", ""} and 50 < got.count("") < 110


def test_packing_by_hand(spark):
    rows = spark.createDataFrame([(k, 10) for k in range(3)], "k long, n long").coalesce(1)
    assert [r["batch"] for r in S.pack_batches(rows, "k", "n", 10, 2).orderBy("k").collect()] == [0, 1, 2]  # 20 < 20 is false


def test_solution_configs(spark):
    picks = spark.createDataFrame([(0, 5, 0.1), (1, 9, 0.1)], "place int, type long, objective double")
    got = solution_configs(picks, spark.createDataFrame([(5, "city")], "type long, name string"), {"train": "t.tsv"})
    assert [x["name"] for x in got["model"]["objectives"]] == ["city", "type_9"] and got["disambiguator"]["classification"] == ["classifications/city", "classifications/type_9"]


def test_precision_without_predictions(spark):
    conf = spark.createDataFrame([(0, 5, 5, 0), (1, 0, 0, 5)], "class int, tp long, fp long, fn long")
    row = E.weighted_f1(conf).first()
    assert row["precision"] == 25.0 and row["recall"] == 50.0


def test_tagger(spark):
    from loomgraph.operators import tagger

    tokens = spark.createDataFrame([("running", "V"), ("sing", "V"), ("house", "N"), ("mouse", "N"), ("ring", "N"), ("x", None), ("", "N")], "token string, label string")
    model = tagger.fit_endings(tokens, "token", "label")
    sentences = spark.createDataFrame([(1, ["going", "blouse", None]), (2, []), (3, None)], "k long, tokens array<string>")
    got = {r["pos"]: [t["tag"] for t in r["tags"]] for r in tagger.tag_sentences(sentences, "k", "tokens", model, 1).collect()}
    assert got == {0: ["V"], 1: ["N"], 2: ["N"]}
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in tagger.predict_proba(sentences, "k", "tokens", model).collect())


def test_learnability(spark):
    from loomgraph.operators import learnability

    rows = [(k, (["stone", "river"] if k % 2 else ["song", "voice"]) + [f"w{k % 7}"], "a" if k % 2 else "b") for k in range(80)]
    got = learnability.report(spark.createDataFrame(rows, "k long, words array<string>, kind string"), "k", "words", "kind", ["a", "none"]).collect()
    assert [(r["type"], r["auc"], r["correct"], r["positive"], r["negative"]) for r in got] == [("a", 1.0, 1.0, 8, 8)]
