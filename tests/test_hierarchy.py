import random

import pytest
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators import hierarchy as H


def brute(parent):
    nodes = set(parent) | set(parent.values())
    cycles = {}
    for v in parent:
        seen, x = [], v
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            ring = seen[seen.index(x):]
            for y in ring:
                cycles[y] = min(ring)
    out = {}
    for v in nodes:
        path = [v]
        while path[0] in parent and path[0] not in cycles:
            path.insert(0, parent[path[0]])
        top = path[0]
        out[v] = (cycles.get(top, top), -1 if v in cycles else len(path) - 1, path)
    below = {v: {w for w in nodes if w != v and v in out[w][2]} for v in nodes}
    return out, below


def links(spark, parent, extra=()):
    rows = [(a, b, "x", 0) for a, b in parent.items()] + [(a, b, "y", 1) for a, b in extra]
    return spark.createDataFrame(rows, "node long, parent long, path string, depth int")


def check(spark, parent, extra=()):
    got = H.hierarchy(links(spark, parent, extra)).cache()
    want, below = brute(parent)
    assert {r["node"]: (r["root"], r["depth"]) for r in got.collect()} == {v: w[:2] for v, w in want.items()}
    assert {r["node"]: r["n_descendants"] for r in got.collect()} == {v: len(b) for v, b in below.items()}
    assert {r["node"]: list(r["path"]) for r in H.paths(got).collect()} == {v: w[2] for v, w in want.items()}
    assert {(r["ancestor"], r["node"]) for r in H.descendants(got).collect()} == {(v, w) for v, b in below.items() for w in b}
    got.unpersist()


def test_random_graphs_with_cycles_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET", 4)  # so that the hub's children are strung together from buckets
    monkeypatch.setattr(H, "CHUNK", 7)
    rng = random.Random(3)
    parent = {v: rng.randrange(v) for v in range(1, 40)} | {v: 100 for v in range(101, 140)}
    parent |= {200: 201, 201: 202, 202: 200, 203: 201, 204: 203, 300: 300, 301: 300, 400: 399}
    check(spark, parent, extra=[(None, 5), (5, None), (1, parent[1]), (1, parent[1])])


def test_chain(spark):
    check(spark, {v: v - 1 for v in range(1, 30)})


def test_empty_and_only_cycles(spark):
    assert H.hierarchy(links(spark, {})).count() == 0
    check(spark, {1: 2, 2: 1, 5: 5})


@pytest.mark.parametrize("n", [1, 5])
def test_ranks_are_places_from_the_end(spark, n):
    arcs = spark.range(n).select(F.col("id").alias("arc"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("next"), F.lit(1).cast("long").alias("step"), F.when(F.col("id") == n - 1, 77).cast("long").alias("root"))
    assert {tuple(r) for r in H.rank_lists(arcs).collect()} == {(i, n - i, n - i, 77) for i in range(n)}


def test_paths_over_many_chunks(spark, monkeypatch):
    """Chunks of a few nodes, so that most stacks are looked up by interval."""
    monkeypatch.setattr(H, "CHUNK", 5)
    parent = {k: (k - 1) // 3 for k in range(1, 60)} | {k: k - 1 for k in range(101, 130)}
    nodes = storage.cut(H.hierarchy(spark.createDataFrame(list(parent.items()), "node long, parent long")), "nodes")
    got = {r["node"]: list(r["path"]) for r in H.paths(nodes).collect()}

    def path(k):
        return (path(parent[k]) if k in parent else []) + [k]

    assert got == {k: path(k) for k in set(parent) | set(parent.values())}


def test_ids_of_any_form(spark, tmp_path):
    """An id that isn't Q and a number is numbered; paths and roots give it back."""
    from loomgraph.plans import problems

    def record(k, qid, up=None):
        claims = "{}" if up is None else '{"P131": [{"mainsnak": {"datavalue": {"value": {"id": "%s"}}}}]}' % up
        return (k, '{"id": "%s", "lastrevid": 1, "claims": %s}' % (qid, claims), None)

    rows = [record(0, "Q5"), record(1, "L77-S1", "Q5"), record(2, "Q8", "L77-S1"), record(3, "Q123456789012345678901", "Q8"), record(4, "Q9", "X404")]
    spark.createDataFrame(rows, "line_no long, json_line string, dumped_at timestamp").write.parquet(f"{tmp_path}/entity_dump.parquet")
    got = {r["qid"]: (r["root_qid"], r["tree_depth"], r["path"]) for r in problems.p2_hierarchy(spark, str(tmp_path)).collect()}
    assert got == {"Q5": ("Q5", 0, "Q5"), "L77-S1": ("Q5", 1, "Q5>L77-S1"), "Q8": ("Q5", 2, "Q5>L77-S1>Q8"), "Q123456789012345678901": ("Q5", 3, "Q5>L77-S1>Q8>Q123456789012345678901")}
