"""Problem 2: parent-child links of unknown depth as full hierarchies, by Euler tours and parallel list ranking.

The links are a graph in which each node has at most one parent. In rounds whose number grows with the logarithm of the depth
or of the size:

1. Leaves are peeled, 1, 2, 4, 8 ... layers a round: what is left are the cycles.
2. The links within cycles are cut, so that a forest remains whose roots are the parentless nodes and the cycle members.
3. Each link gives two arcs, down into the node and up out of it; with the children of each node in a fixed order the
   arcs of a tree make one list, its Euler tour.
4. The lists are ranked by pointer jumping, first between sampled rulers, then over the rulers alone, so that only
   a fraction of the arcs takes part in most rounds.
5. The places of a node's two arcs are its interval; depth, descendants, ancestors and paths follow from the intervals.

No step gathers a tree, a cycle or the children of one node in one task: orders are made within bounded buckets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from loomgraph import storage

#: Children of one node that are ordered in one window; more are spread over buckets.
BUCKET = 50_000
#: Parents that may be broadcast for having more.
MOST_HOT = 100_000
#: One arc in so many is a ruler.
RULER = 8
#: Nodes in a chunk of the path scan.
CHUNK = 20_000
MOST_ROUNDS = 64


def _rounds():
    """Counts rounds; beyond MOST_ROUNDS a doubling loop can't be right, as that would cover 2**64 nodes."""
    yield from range(MOST_ROUNDS)
    raise RuntimeError("a doubling loop didn't end")


def peel_to_cycles(links: DataFrame) -> DataFrame:
    """The nodes on cycles, of links (node, parent). In round k the next 2**k layers from the leaves go.

    up(node) is the ancestor at distance 2**k. A node is left after the round if it is up of some node that was left
    before. If no node went, then none of them has a finite height, so that each lies on a cycle.
    """
    up, n = links.select("node", F.col("parent").alias("up")), -1
    for _ in _rounds():
        nodes = storage.cut(up.select(F.col("up").alias("node")).distinct(), "peel")
        now = nodes.count()
        if now in (n, 0):
            storage.drop(up)
            return nodes
        far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        nxt = storage.cut(nodes.join(up, "node").join(far, "up").select("node", F.col("far").alias("up")), "peel-up")
        storage.drop(up, nodes)
        up, n = nxt, now


def cycle_minimum(links: DataFrame, cycle_nodes: DataFrame) -> DataFrame:
    """(node, least): for each node on a cycle the smallest member of its cycle, by doubling along the cycle."""
    state = storage.cut(links.join(cycle_nodes, "node").select("node", F.col("parent").alias("up"), F.least("node", "parent").alias("least")), "cycle")
    # least covers the node and the first 2**k nodes above it, up is the last of them
    for _ in _rounds():
        far = state.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("least").alias("far_least"))
        nxt = storage.cut(state.join(far, "up").select("node", F.col("far").alias("up"), F.least("least", "far_least").alias("least"), (F.col("far_least") < F.col("least")).alias("moved")), "cycle")
        moved = not nxt.where("moved").isEmpty()
        storage.drop(state)
        if not moved:
            return nxt.select("node", "least")
        state = nxt.drop("moved")
        state._loomgraph_path = nxt._loomgraph_path


def _sibling_order(tree: DataFrame, n_links: int) -> tuple[DataFrame, DataFrame]:
    """(node, next sibling or null), and (parent, first and last child); siblings ordered by (bucket, node).

    A parent with more than BUCKET children has them ordered within hashed buckets, which are then strung together. There is at most one such parent
    for BUCKET links; while that bounds them to MOST_HOT they are broadcast, else Spark chooses the join.
    """
    many = tree.groupBy("parent").count().where(F.col("count") > BUCKET).select("parent", (F.col("count") / BUCKET + 1).cast("int").alias("buckets"))
    many = F.broadcast(many) if n_links // BUCKET <= MOST_HOT else many
    spread = tree.join(many, "parent", "left").select("node", "parent", F.when(F.col("buckets").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "buckets")).cast("int").alias("bucket"), F.col("buckets").isNotNull().alias("hot"))
    order = F.struct("bucket", "node")
    ends = spread.groupBy("parent").agg(F.min(order).alias("a"), F.max(order).alias("z")).select("parent", F.col("a.node").alias("first"), F.col("z.node").alias("last"))
    within = spread.select("node", "parent", "bucket", "hot", F.lead("node").over(W.partitionBy("parent", "bucket").orderBy("node")).alias("next"))
    seams = (
        spread.where("hot").groupBy("parent", "bucket").agg(F.min("node").alias("head"), F.max("node").alias("node"))
        .select("node", F.lead("head").over(W.partitionBy("parent").orderBy("bucket")).alias("next"))
    )
    siblings = within.where("next is not null or not hot").select("node", "next").unionByName(seams)
    return siblings, ends


def euler_arcs(tree: DataFrame, n_links: int) -> tuple[DataFrame, DataFrame]:
    """(arc, next, step, root), and (parent, first, last, inner): the tours of tree's links (node, parent), which have no cycles.

    The arc down into node x is 2x, the arc up out of it 2x + 1; step is +1 or -1. next is null at a tour's end, where
    root has the tree's root. inner tells whether the parent has a parent itself.
    """
    siblings, ends = _sibling_order(tree, n_links)
    has_parent = tree.select(F.col("node").alias("parent"), F.lit(True).alias("inner"))
    ends = storage.cut(ends.join(has_parent, "parent", "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "ends")
    none = F.lit(None).cast("long")

    def arcs(rows: DataFrame, arc: Column, nxt: Column, step: int, root: Column = none) -> DataFrame:
        return rows.select(arc.alias("arc"), nxt.cast("long").alias("next"), F.lit(step).cast("long").alias("step"), root.alias("root"))

    node, parent = F.col("node"), F.col("parent")
    out = arcs(ends.where("inner"), parent * 2, F.col("first") * 2, 1)
    out = out.unionByName(arcs(tree.select("node").join(ends.select(parent.alias("node")), "node", "left_anti"), node * 2, node * 2 + 1, 1))
    out = out.unionByName(arcs(siblings.where("next is not null"), node * 2 + 1, F.col("next") * 2, -1))
    out = out.unionByName(arcs(ends, F.col("last") * 2 + 1, F.when(F.col("inner"), parent * 2 + 1), -1, F.when(~F.col("inner"), parent)))
    return out, ends


def rank_lists(arcs: DataFrame) -> DataFrame:
    """(arc, rank, weight, root): of each arc the number of arcs from it to its list's end, itself included, the sum of their steps, and root of the end.

    Pointer jumping in two levels. First each arc jumps only up to the next ruler (one arc in RULER, by a hash), which
    takes about log2(RULER ln n) rounds and drops an arc when it has arrived; then the rulers, a list shorter by RULER,
    are ranked among themselves; last each arc adds what its ruler has.
    """
    halt = F.col("to").isNull() | _is_ruler("to")
    # to: where the arc has got to, null beyond the end; rank, weight: what lies between, the arc itself included
    table = storage.cut(arcs.select("arc", F.col("next").alias("to"), F.lit(1).cast("long").alias("rank"), F.col("step").alias("weight"), "root"), "rank")
    arrived, going = table.where(halt), table.where(~halt)
    for _ in _rounds():
        if going.isEmpty():
            break
        known = arrived.unionByName(going).where(~_is_ruler("arc"))  # nobody jumps over a ruler
        table = storage.cut(_moved(going, known), "rank")
        arrived, going = arrived.unionByName(table.where(halt)), table.where(~halt)
    rulers = _all_jumps(arrived.where(_is_ruler("arc")))
    tail = rulers.select(F.col("arc").alias("to"), F.col("rank").alias("more_rank"), F.col("weight").alias("more_weight"), F.col("root").alias("more_root"))
    through = arrived.where("to is not null").join(tail, "to").select("arc", (F.col("rank") + F.col("more_rank")).alias("rank"), (F.col("weight") + F.col("more_weight")).alias("weight"), F.col("more_root").alias("root"))
    return arrived.where("to is null").select("arc", "rank", "weight", "root").unionByName(through)


def _is_ruler(arc: str) -> Column:
    return F.pmod(F.xxhash64(arc, F.lit(97)), F.lit(RULER)) == 0


def _moved(going: DataFrame, table: DataFrame) -> DataFrame:
    far = table.select(F.col("arc").alias("to"), F.col("to").alias("far"), F.col("rank").alias("far_rank"), F.col("weight").alias("far_weight"), F.col("root").alias("far_root"))
    return going.join(far, "to").select("arc", F.col("far").alias("to"), (F.col("rank") + F.col("far_rank")).alias("rank"), (F.col("weight") + F.col("far_weight")).alias("weight"), F.col("far_root").alias("root"))


def _all_jumps(state: DataFrame) -> DataFrame:
    """Plain pointer jumping to the end of each list; arcs that have arrived stay as they are."""
    state = storage.cut(state, "rulers")
    for _ in _rounds():
        going = state.where("to is not null")
        if going.isEmpty():
            return state
        nxt = storage.cut(state.where("to is null").unionByName(_moved(going, state)), "rulers")
        storage.drop(state)
        state = nxt


def hierarchy(links: DataFrame) -> DataFrame:
    """links (node long, parent long), each node once, to (node, parent, root, depth, on_cycle, first_place, last_place, n_descendants, tree).

    One row per node that has a parent or is one. A root has depth 0 and itself as root. A node on a cycle (also its own
    parent) has depth -1 and as root the smallest member; below a cycle the root is that same member and depth the number of
    steps up to the first member. tree is the top of the tree that a node hangs in: its root, or the member of the cycle.
    Places count a tree's tour from its end: x is below y if they have the same tree and
    first_place(y) < first_place(x) <= last_place(x) < last_place(y). n_descendants counts all nodes below, around a
    cycle only those hanging below that member. Links with a null on either side are left out, further columns are ignored, repeated
    links count once; a node with several different parents is an error of the caller (the smallest is taken). Ids must
    lie within -2**61 and 2**61. An empty table gives no rows.
    """
    given = links.select(F.col("node").cast("long"), F.col("parent").cast("long")).where("node is not null and parent is not null")
    given = storage.cut(given.groupBy("node").agg(F.min("parent").alias("parent")), "links")
    n_links = given.count()
    cycles = peel_to_cycles(given)
    least = cycle_minimum(given, cycles)
    tree = storage.cut(given.join(cycles, "node", "left_anti"), "tree")
    arcs, ends = euler_arcs(tree, n_links)
    ranked = rank_lists(arcs)
    down = F.pmod("arc", F.lit(2)) == 0
    node_of = F.expr("(arc - pmod(arc, 2)) div 2")
    nodes = (
        ranked.select(node_of.alias("node"), "root", F.when(down, F.col("rank")).alias("d"), F.when(~down, F.col("rank")).alias("u"), F.when(down, 1 - F.col("weight")).alias("depth"))
        .groupBy("node").agg(F.max("root").alias("tree"), F.max("d").alias("last_place"), F.max("u").alias("first_place"), F.max("depth").cast("int").alias("depth"))
    )
    # a tree's size in its top's row: counted per tree, then joined to tops only, each of which occurs once
    nodes = storage.cut(nodes.join(tree, "node"), "nodes")
    sizes = nodes.groupBy(F.col("tree").alias("node")).agg(F.count("*").alias("n"))
    tops = ends.where("not inner").select(F.col("parent").alias("node")).unionByName(cycles).distinct()
    tops = tops.join(sizes, "node", "left").join(given.join(cycles, "node", "left_semi"), "node", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    tops = tops.select("node", "parent", F.col("node").alias("tree"), F.lit(0).cast("long").alias("first_place"), (2 * n + 1).alias("last_place"), F.lit(0).alias("depth"), n.alias("n_descendants"), F.lit(True).alias("top"))
    below = nodes.select("node", "parent", "tree", "first_place", "last_place", "depth", F.expr("(last_place - first_place - 1) div 2").alias("n_descendants"), F.lit(False).alias("top"))
    every = tops.unionByName(below)
    return _with_cycle_roots(every, least)


def _with_cycle_roots(every: DataFrame, least: DataFrame) -> DataFrame:
    """Root and cycle mark from the tree's top. Trees may be of any size, so that one may hold most rows: the join is spread.

    The cycle members (each once) are repeated for 32 salts and rows draw one by a hash, so that no task gets more than a
    thirty-second of one tree beside its share of the rest.
    """
    salts = 32
    member = least.select(F.col("node").alias("tree"), "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = every.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    out = rows.join(member, ["tree", "salt"], "left")
    on_cycle = F.col("top") & F.col("least").isNotNull()
    return out.select(
        "node", "parent", F.coalesce("least", "tree").alias("root"), F.when(on_cycle, -1).otherwise(F.col("depth")).cast("int").alias("depth"),
        on_cycle.alias("on_cycle"), "first_place", "last_place", "n_descendants", "tree",
    )


def paths(nodes: DataFrame) -> DataFrame:
    """(node, path array<long>): from the tree's top down to the node, from hierarchy's places. nodes must be a written table.

    Rows sorted by (tree, place) are a walk through each tree; a chunk of it is scanned with a stack. What the stack
    holds at a chunk's start are the ancestors of its first row: the nodes whose interval holds that row's place. Those are
    looked up by interval for the first rows alone, one for each chunk of CHUNK nodes. A path's length is its node's depth.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    chunks = max(1, -(-n // CHUNK))
    walk = nodes.select("node", "tree", (-F.col("last_place")).alias("enter"), (-F.col("first_place")).alias("leave"))
    walk = walk.repartitionByRange(chunks, "tree", "enter").sortWithinPartitions("tree", "enter").withColumn("chunk", F.spark_partition_id())
    walk = storage.cut(walk, "walk")
    starts = walk.groupBy("chunk").agg(F.min(F.struct("tree", "enter")).alias("s")).select("chunk", "s.tree", F.col("s.enter").alias("at"))
    stacks = _around(walk.select("node", "tree", "enter", "leave"), starts).select(*[F.col(c).alias(c) for c in ("chunk", "node", "enter", "leave")])

    def scan(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, above = rows.sort_values(["tree", "enter"]), above.sort_values("enter")
        stack = list(zip(above["node"], above["leave"], strict=True))
        tree, out = rows["tree"].iloc[0] if len(rows) else None, []
        for node, t, enter, leave in zip(rows["node"], rows["tree"], rows["enter"], rows["leave"], strict=True):
            if t != tree:
                stack, tree = [], t
            while stack and stack[-1][1] < enter:
                stack.pop()
            stack.append((node, leave))
            out.append([x for x, _ in stack])
        return pd.DataFrame({"node": rows["node"], "path": out})

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("path", T.ArrayType(T.LongType()))])
    return walk.groupBy("chunk").cogroup(stacks.groupBy("chunk")).applyInPandas(scan, schema) if n else spark.createDataFrame([], schema)


def _around(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """Points (tree, at, ...) with each interval (tree, enter, leave, ...) that has them strictly inside.

    An interval of up to 2**k places lies in one or two stretches of 2**k, a point in one stretch for each k: so that an equi-join finds the
    pairs, with at most two rows for an interval and 64 for a point.
    """
    level = F.ceil(F.log2(F.col("leave") - F.col("enter") + 1)).cast("int")
    own = intervals.withColumn("level", level)
    own = own.withColumn("stretch", F.explode(F.expr("array_distinct(array(shiftright(enter, level), shiftright(leave, level)))")))
    most = int(own.agg(F.max("level")).first()[0] or 0)  # at most 63
    asked = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("stretch", F.expr("shiftright(at, level)"))
    return own.join(asked, ["tree", "level", "stretch"]).where("enter < at and at < leave")


#: Places in a bucket of the interval join of descendants().
SPAN = 1_024


def descendants(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(ancestor, node): all descendants of the nodes in `of` (one column, node), or of all nodes, by their intervals.

    Places of a tree are cut into buckets of SPAN. An asked node is joined to the buckets that its interval meets, so that besides the
    pairs of the result it meets at most the rest of its first and last bucket, however large the tree is.
    The result has as many rows as there are such pairs.
    """
    asked = nodes.where("last_place > first_place + 1")
    if of is not None:
        asked = asked.join(of.select("node").distinct(), "node", "left_semi")
    bucket = F.explode(F.sequence(F.expr(f"first_place div {SPAN}"), F.expr(f"last_place div {SPAN}")))
    asked = asked.select(F.col("node").alias("ancestor"), "tree", F.col("first_place").alias("a"), F.col("last_place").alias("z"), bucket.alias("bucket"))
    below = nodes.select("node", "tree", "first_place", "last_place", F.expr(f"first_place div {SPAN}").alias("bucket"))
    return asked.join(below, ["tree", "bucket"]).where("first_place > a and last_place < z").select("ancestor", "node")
