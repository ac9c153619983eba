"""Queries of sources, scalar functions, joins, graph operators and classification over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators import nested
from loomgraph.operators import sequences as S
from loomgraph.operators.graph import Rule, TypeGraph
from loomgraph.operators.search import compact
from loomgraph.plans import model as M
from loomgraph.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _graph(spark, sf_dir, *, bad: bool = False) -> TypeGraph:
    """The graph with its edges written once; bad: forbids core entities whose number ends in 7, and links between numbers of equal last digit."""
    edges = storage.cut(M.edges(spark, sf_dir), "edges")
    if not bad:
        return TypeGraph(edges)
    nodes = table(spark, sf_dir, "core_entities").where("entity % 10 = 7").select(F.col("entity").cast("long"))
    pairs = edges.where("child % 10 = parent % 10").select("child", "parent").distinct()
    return TypeGraph(edges, nodes, pairs)


def _core(n: int) -> tuple[int, ...]:
    return tuple(range(n))


def _seeds(s, d) -> DataFrame:
    return table(s, d, "core_entities").where("kind_name = 'city'").select(F.col("entity").cast("long"))


_BAD = """bad_node AS (SELECT entity FROM core_entities WHERE entity % 10 = 7),
bad_pair AS (SELECT DISTINCT child, parent FROM edges WHERE child % 10 = parent % 10)"""


# -- records and links -------------------------------------------------------------------------------------------------

query("scan_json_lines", f"WITH {M._RECORDS} SELECT qid FROM recs")(lambda s, d: nested.records(table(s, d, "entity_dump")).select("qid"))
query("prune_nested_fields", f"WITH {M._RECORDS} SELECT qid, count(*) AS n_leaves FROM leaves WHERE leaf_kind IN ('main', 'qualifier') GROUP BY qid")(
    lambda s, d: M.leaves(s, d).where("leaf_kind in ('main', 'qualifier')").groupBy("qid").agg(F.count("*").alias("n_leaves"))
)
query("entity_index", f"WITH {M.ENTITIES} SELECT entity, qid FROM entities")(lambda s, d: M.entities(s, d))
query("known_names", f"WITH {M.TITLES} SELECT entity, min(title) AS name FROM titles WHERE wiki = 'enwiki' GROUP BY entity")(
    lambda s, d: M.titles(s, d).where("wiki = 'enwiki'").groupBy("entity").agg(F.min("title").alias("name"))
)
query("json_nested_project", f"WITH {M._RECORDS} SELECT qid, prop, claim_no, leaf_text FROM leaves WHERE leaf_kind = 'main' AND prop IN ('P31', 'P279', 'P569')")(
    lambda s, d: M.leaves(s, d).where("leaf_kind = 'main' and prop in ('P31', 'P279', 'P569')").select("qid", "prop", "claim_no", "leaf_text")
)
query("sitelink_explode", f"WITH {M._RECORDS} SELECT prop || '/' || leaf_text AS wiki_title, qid FROM leaves WHERE leaf_kind = 'sitelink'")(
    lambda s, d: M.leaves(s, d).where("leaf_kind = 'sitelink'").select(F.concat_ws("/", "prop", "leaf_text").alias("wiki_title"), "qid")
)
query("parse_year", f"WITH {M._RECORDS}, {M.ENTITIES}, {M.DATES} SELECT * FROM dates")(lambda s, d: M.dates(s, d))
query("first_temporal", f"WITH {M._RECORDS}, {M.ENTITIES}, {M.DATES} SELECT prop, entity, arg_min(year, pos) AS year FROM dates GROUP BY prop, entity")(
    lambda s, d: M.dates(s, d).groupBy("prop", "entity").agg(F.min_by("year", "pos").alias("year"))
)
query("resolve_edges", f"WITH {M.EDGES} SELECT * FROM edges")(lambda s, d: M.edges(s, d))


@query("resolve_edges_left", f"WITH {M.EDGES} SELECT l.prop, a.entity AS child, coalesce(b.entity, -1) AS parent, l.claim_no AS pos FROM leaves l JOIN entities a ON a.qid = l.qid LEFT JOIN entities b ON b.qid = l.leaf_text WHERE leaf_kind = 'main' AND leaf_text LIKE 'Q%'")
def resolve_edges_left(s, d) -> DataFrame:
    ids = M.entities(s, d)
    main = M.leaves(s, d).where("leaf_kind = 'main' and leaf_text like 'Q%'").select("prop", "qid", F.col("leaf_text").alias("target"), F.col("claim_no").alias("pos"))
    out = main.join(ids.select("qid", F.col("entity").alias("child")), "qid").join(ids.select(F.col("qid").alias("target"), F.col("entity").alias("parent")), "target", "left")
    return out.select("prop", "child", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), "pos")


# -- relations ---------------------------------------------------------------------------------------------------------

query("relation_lookup", f"WITH {M.EDGES} SELECT child AS source, parent AS target FROM edges WHERE prop = 'P31'")(lambda s, d: TypeGraph(M.edges(s, d)).relation("P31"))
query("invert_relation", f"WITH {M.EDGES} SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY child) - 1 AS pos, child FROM (SELECT DISTINCT parent, child FROM edges WHERE prop = 'P279')")(
    lambda s, d: TypeGraph(M.edges(s, d)).inverted("P279")
)
query("out_degree", f"WITH {M.EDGES} SELECT n.entity, count(e.child) AS degree FROM (SELECT DISTINCT entity FROM entities) n LEFT JOIN edges e ON e.child = n.entity AND e.prop = 'P31' GROUP BY n.entity")(
    lambda s, d: TypeGraph(M.edges(s, d)).out_degree(M.entities(s, d).select("entity").distinct(), "P31")
)
query("edges_of_set", f"WITH {M.EDGES} SELECT * FROM edges WHERE child IN (SELECT child FROM edges WHERE prop = 'P279')")(
    lambda s, d: (lambda g: g.edges_of(g.relation("P279").select(F.col("source").alias("entity"))).select("prop", "child", "parent", "pos"))(_graph(s, d))
)
query("disconnected_entities", f"WITH {M.EDGES} SELECT DISTINCT entity FROM entities WHERE entity NOT IN (SELECT child FROM edges WHERE prop IN ('P31', 'P279', 'P361', 'P131'))")(
    lambda s, d: M.entities(s, d).select("entity").distinct().join(M.edges(s, d).where("prop in ('P31', 'P279', 'P361', 'P131')").select(F.col("child").alias("entity")), "entity", "left_anti")
)
query("one_hop_successors", f"WITH {M.EDGES}, {_BAD} SELECT DISTINCT e.child AS entity FROM edges e ANTI JOIN bad_pair b ON b.child = e.child AND b.parent = e.parent WHERE prop IN ('P31', 'P279') AND e.parent IN (SELECT entity FROM core_entities WHERE kind_name = 'city')")(
    lambda s, d: _graph(s, d, bad=True).successors(["P31", "P279"], _seeds(s, d))
)
_WALK = "WITH RECURSIVE {edges}, {extra}seeds AS (SELECT CAST(entity AS BIGINT) AS entity FROM core_entities WHERE kind_name = 'city'), walk AS (SELECT entity{d0} FROM seeds UNION{all} SELECT e.child{d1} FROM walk w JOIN edges e ON e.parent = w.entity WHERE e.prop IN ({props}){more}) SELECT DISTINCT entity FROM walk{last}"
query("closure_full", _WALK.replace("SELECT CAST(entity AS BIGINT) AS entity FROM core_entities WHERE kind_name = 'city'", "SELECT DISTINCT child AS entity FROM edges WHERE prop = 'P361'").format(edges=M.EDGES, extra="", d0="", d1="", all="", props="'P279'", more="", last=""))(
    lambda s, d: (lambda g: g.satisfy(["P279"], g.relation("P361").select(F.col("source").alias("entity")).distinct()))(_graph(s, d))
)
query("closure_multi_relation", _WALK.format(edges=M.EDGES, extra="", d0="", d1="", all="", props="'P31', 'P279', 'P131', 'P171'", more="", last=""))(
    lambda s, d: _graph(s, d).satisfy(["P31", "P279", "P131", "P171"], _seeds(s, d))
)
query("closure_max_steps", _WALK.format(edges=M.EDGES, extra="", d0=", 0 AS d", d1=", w.d + 1", all="", props="'P31', 'P279', 'P131', 'P171'", more=" AND w.d < 3", last=""))(
    lambda s, d: _graph(s, d).satisfy(["P31", "P279", "P131", "P171"], _seeds(s, d), 3)
)
query(
    "closure_blacklist",
    _WALK.format(
        edges=M.EDGES, extra=_BAD + ", ", d0="", d1="", all="", props="'P31', 'P279', 'P131', 'P171'",
        more=" AND e.child NOT IN (SELECT entity FROM bad_node) AND NOT EXISTS (SELECT 1 FROM bad_pair b WHERE b.child = e.child AND b.parent = e.parent)", last=" WHERE entity NOT IN (SELECT entity FROM bad_node)",
    ),
)(lambda s, d: _graph(s, d, bad=True).satisfy(["P31", "P279", "P131", "P171"], _seeds(s, d)))
RULES = [Rule(k, ("P31", "P279") if k % 2 else ("P131",), (k, k + 50), None if k % 3 else 2) for k in range(40)]
query(
    "closure_batched",
    f"WITH RECURSIVE {M.EDGES}, rules AS (SELECT CAST(k AS INTEGER) AS rule_id, k % 2 = 1 AS typed, CASE WHEN k % 3 = 0 THEN 2 ELSE 1000 END AS most FROM range(40) t(k)), "
    "walk AS (SELECT rule_id, CAST(rule_id AS BIGINT) AS entity, 0 AS d FROM rules UNION SELECT rule_id, rule_id + 50, 0 FROM rules UNION "
    "SELECT w.rule_id, e.child, CASE WHEN r.most = 1000 THEN 0 ELSE w.d + 1 END FROM walk w JOIN rules r USING (rule_id) JOIN edges e ON e.parent = w.entity AND (CASE WHEN typed THEN e.prop IN ('P31', 'P279') ELSE e.prop = 'P131' END) WHERE w.d < r.most) "
    "SELECT DISTINCT rule_id, entity FROM walk",
)(lambda s, d: _graph(s, d).closures(RULES))
query("blacklist_resolve", f"WITH {M.EDGES}, {_BAD} SELECT child, parent FROM bad_pair")(lambda s, d: _graph(s, d, bad=True).bad_pairs)


@query(
    "connection_path",
    f"""WITH RECURSIVE {M.EDGES}, links AS (SELECT DISTINCT prop, child, parent FROM edges WHERE prop IN ('P31', 'P279')),
least(entity, d) USING KEY (entity) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT l.child, min(x.d) + 1 FROM least x JOIN links l ON l.parent = x.entity ANTI JOIN recurring.least y ON y.entity = l.child GROUP BY l.child),
paths AS (SELECT entity, d, [CAST(entity AS VARCHAR)] AS path FROM least WHERE d = 0 UNION ALL
    SELECT x.entity, x.d, x.path FROM (SELECT c.entity, c.d, min([CAST(c.entity AS VARCHAR), l.prop] || p.path) AS path FROM paths p JOIN links l ON l.parent = p.entity JOIN least c ON c.entity = l.child AND c.d = p.d + 1 GROUP BY c.entity, c.d) x)
SELECT entity, array_to_string(path, ' ') AS path FROM paths""",
)
def connection_path(s, d) -> DataFrame:
    g = _graph(s, d)
    return g.connection_path(["P31", "P279"], M.entities(s, d), 3).select("entity", F.array_join("path", " ").alias("path"))


query(
    "typed_path_reach",
    f"""WITH {M.EDGES}, one AS (SELECT DISTINCT child AS source, parent AS entity FROM edges WHERE prop = 'P131'),
up AS (SELECT DISTINCT child, parent FROM edges WHERE prop = 'P131'),
a AS (SELECT DISTINCT o.source, u.parent AS entity FROM one o JOIN up u ON u.child = o.entity),
b AS (SELECT DISTINCT a.source, u.parent AS entity FROM a JOIN up u ON u.child = a.entity) SELECT * FROM a UNION SELECT * FROM b""",
)(lambda s, d: (lambda g: g.path_reach(M.entities(s, d).select("entity"), [("P131", 1), ("P131", 2)]))(_graph(s, d)))
_DEGREES = f"WITH {M.EDGES}, n AS (SELECT child AS entity, count(*) AS k FROM edges WHERE prop = 'P31' GROUP BY child)"


def _degrees(s, d) -> DataFrame:
    return storage.cut(M.edges(s, d).where("prop = 'P31'").groupBy(F.col("child").alias("entity")).agg(F.count("*").alias("k")), "degrees")


query("delta_encode", _DEGREES + " SELECT entity, entity - lag(entity, 1, CAST(0 AS BIGINT)) OVER (ORDER BY entity) AS delta, k FROM n")(lambda s, d: S.delta_encode(_degrees(s, d), "entity").select("entity", "delta", "k"))
query("delta_decode", _DEGREES + " SELECT row_number() OVER (ORDER BY entity) - 1 AS place, entity AS number FROM n")(
    lambda s, d: (lambda x: S.delta_decode(x.join(compact(x.select("entity")), "entity").select(F.col("dense").alias("place"), "delta"), "place").select("place", "number"))(storage.cut(S.delta_encode(_degrees(s, d), "entity"), "deltas"))
)
