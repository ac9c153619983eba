"""Queries of the general problems: heavy keys (1), hierarchies (2) and nested records (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators import heavy_keys, hierarchy, nested, skew
from loomgraph.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = storage.cut(heavy_keys.key_totals(table(spark, sf_dir, "surface_dictionary")), "p1")
    return heavy_keys.found(totals, one_in=100)


def p1_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.key_totals(table(spark, sf_dir, "surface_dictionary"))


_SLOTS = """slots AS (SELECT slot_id, any_value(trie_index) AS trie_index, any_value(trie_index2indices_values) AS entity,
    any_value(trie_index2indices_counts) AS cnt FROM surface_dictionary GROUP BY slot_id),
keyed AS (SELECT 'surface' AS key_kind, trie_index AS key_id, cnt FROM slots
    UNION ALL SELECT 'entity', CAST(entity AS BIGINT), cnt FROM slots WHERE entity >= 0),
totals AS (SELECT key_kind, key_id, count(*) AS n_slots, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS sum_counts FROM keyed GROUP BY ALL)"""

QUERIES |= {"p1_found": p1_found, "p1_key_totals": p1_key_totals}
SQL |= {
    "p1_found": f"WITH {_SLOTS} SELECT key_kind, key_id FROM totals WHERE n_slots * 100 >= (SELECT count(*) FROM slots)",
    "p1_key_totals": f"WITH {_SLOTS} SELECT * FROM totals",
}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.records(table(spark, sf_dir, "entity_dump"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.leaf_rows(_records(spark, sf_dir))


def _flat(name: str):
    return lambda spark, sf_dir: nested.flat_tables(nested.records(table(spark, sf_dir, "entity_dump"), structure=True))[name]


QUERIES |= {"p5_found": p5_found, **{f"p5_{n}": _flat(n) for n in ("records", "claims", "qualifiers", "references", "reference_snaks", "sitelinks")}}

_RECORDS = r"""lines AS (SELECT line_no, regexp_replace(json_line, '[ ,\r\n\t]+$', '') AS j FROM entity_dump WHERE json_line LIKE '{%'),
parsed AS (SELECT line_no, CAST(j AS JSON) AS j FROM lines WHERE json_valid(j)),
named AS (SELECT j->>'id' AS qid, j, row_number() OVER (PARTITION BY j->>'id' ORDER BY CAST(j->>'lastrevid' AS BIGINT) DESC, line_no DESC) AS k FROM parsed
    WHERE json_type(j, '$.id') = 'VARCHAR'),
recs AS MATERIALIZED (SELECT qid, j FROM named WHERE k = 1),
props AS (SELECT qid, unnest(json_keys(j->'claims')) AS prop, j->'claims' AS c FROM recs WHERE json_type(j->'claims') = 'OBJECT'),
arrays AS (SELECT qid, prop, c->prop AS a FROM props WHERE json_type(c->prop) = 'ARRAY'),
claims AS MATERIALIZED (SELECT qid, prop, CAST(n AS INTEGER) AS claim_no, a->n AS c FROM arrays, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS t(n)),
q_props AS (SELECT qid, prop, claim_no, unnest(json_keys(c->'qualifiers')) AS sub_prop, c->'qualifiers' AS q FROM claims WHERE json_type(c->'qualifiers') = 'OBJECT'),
q_snaks AS (SELECT qid, prop, claim_no, sub_prop, n, (q->sub_prop)->n AS s FROM q_props, unnest(range(CAST(json_array_length(q->sub_prop) AS BIGINT))) AS t(n)
    WHERE json_type(q->sub_prop) = 'ARRAY'),
refs AS (SELECT qid, prop, claim_no, CAST(n AS INTEGER) AS ref_no, ((c->'references')->n)->'snaks' AS r FROM claims, unnest(range(CAST(json_array_length(c->'references') AS BIGINT))) AS t(n)
    WHERE json_type(c->'references') = 'ARRAY'),
r_props AS (SELECT qid, prop, claim_no, ref_no, r, unnest(json_keys(r)) AS sub_prop FROM refs WHERE json_type(r) = 'OBJECT'),
r_snaks AS (SELECT qid, prop, claim_no, ref_no, sub_prop, n, (r->sub_prop)->n AS s FROM r_props, unnest(range(CAST(json_array_length(r->sub_prop) AS BIGINT))) AS t(n)
    WHERE json_type(r->sub_prop) = 'ARRAY'),
sites AS (SELECT qid, unnest(json_keys(j->'sitelinks')) AS prop, j->'sitelinks' AS s FROM recs WHERE json_type(j->'sitelinks') = 'OBJECT'),
held AS (SELECT qid, 'main' AS leaf_kind, prop, claim_no, -1 AS ref_no, '' AS sub_prop, -1 AS sub_no, (c->'mainsnak')->'datavalue'->'value' AS v FROM claims
    UNION ALL SELECT qid, 'qualifier', prop, claim_no, -1, sub_prop, CAST(n AS INTEGER), s->'datavalue'->'value' FROM q_snaks
    UNION ALL SELECT qid, 'reference', prop, claim_no, ref_no, sub_prop, CAST(n AS INTEGER), s->'datavalue'->'value' FROM r_snaks),
leaves AS (SELECT * EXCLUDE (v), coalesce(v->>'id', v->>'time') AS leaf_text FROM held WHERE json_type(v) = 'OBJECT' AND coalesce(v->>'id', v->>'time') IS NOT NULL
    UNION ALL SELECT qid, 'sitelink', prop, -1, -1, '', -1, (s->prop)->>'title' FROM sites WHERE prop LIKE '%wiki' AND (s->prop)->>'title' IS NOT NULL)"""
_CLAIM, _REF = "qid || '/' || prop || '/' || claim_no", "qid || '/' || prop || '/' || claim_no || '/' || ref_no"
SQL |= {
    "p5_found": f"WITH {_RECORDS} SELECT * FROM leaves",
    "p5_records": f"WITH {_RECORDS} SELECT r.qid, count(c.qid) AS n_claims FROM recs r LEFT JOIN (SELECT qid FROM claims WHERE json_type(c) = 'OBJECT') c ON c.qid = r.qid GROUP BY r.qid",
    "p5_claims": f"WITH {_RECORDS} SELECT {_CLAIM} AS claim_id, c.*, l.leaf_text AS main_text FROM (SELECT qid, prop, claim_no FROM claims WHERE json_type(c) = 'OBJECT') c LEFT JOIN (SELECT qid, prop, claim_no, leaf_text FROM leaves WHERE leaf_kind = 'main') l USING (qid, prop, claim_no)",
    "p5_qualifiers": f"WITH {_RECORDS} SELECT {_CLAIM} AS claim_id, sub_prop, sub_no, leaf_text FROM leaves WHERE leaf_kind = 'qualifier'",
    "p5_references": f"WITH {_RECORDS} SELECT {_CLAIM} AS claim_id, ref_no, {_REF} AS ref_id FROM (SELECT qid, prop, claim_no, CAST(n AS INTEGER) AS ref_no FROM claims, unnest(range(CAST(json_array_length(c->'references') AS BIGINT))) AS t(n) WHERE json_type(c->'references') = 'ARRAY' AND json_type((c->'references')->n) = 'OBJECT')",
    "p5_reference_snaks": f"WITH {_RECORDS} SELECT {_REF} AS ref_id, sub_prop, sub_no, leaf_text FROM leaves WHERE leaf_kind = 'reference'",
    "p5_sitelinks": f"WITH {_RECORDS} SELECT qid, prop AS site, leaf_text AS title FROM leaves WHERE leaf_kind = 'sitelink'",
}

# -- problem 2 -------------------------------------------------------------------------------------------------------

PARENT_PROPS = ["P131", "P171", "P279"]
_NUMBER = r"^Q(0|[1-9][0-9]{0,16})$"


#: Ids that aren't Q and at most 17 digits are numbered from here on, after all that are.
_OTHERS = 10**17


def _other_ids(recs: DataFrame) -> DataFrame:
    """(qid, number): records' ids of another form, numbered by hashed bucket and id. Usually there are none."""
    odd = recs.where(~F.col("qid").rlike(_NUMBER)).select("qid", F.pmod(F.xxhash64("qid"), F.lit(4096)).cast("int").alias("b"))
    sizes = odd.groupBy("b").count()  # at most 4,096 rows
    before = sizes.select("b", (F.sum("count").over(Window.orderBy("b")) - F.col("count")).alias("before"))
    own = odd.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("qid")) - 1)
    return storage.cut(own.join(F.broadcast(before), "b").select("qid", (F.lit(_OTHERS) + F.col("before") + F.col("k")).cast("long").alias("number")), "p2-others")


def parent_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame | None]:
    """(node, parent) of all properties in one graph: 4 times the id's number plus the property's place in PARENT_PROPS; and (qid, number)
    of the ids that have no number of their own, None if all have.

    The parent is the first value that is the id of a record; whether it is one is asked for the distinct pairs of target and property only after
    hot targets are set apart.
    """
    recs = storage.cut(nested.links(table(spark, sf_dir, "entity_dump"), PARENT_PROPS).where("qid is not null"), "p2-records")
    others = _other_ids(recs)
    others = None if others.isEmpty() else others

    def numbered(rows: DataFrame, qid: str, name: str) -> DataFrame:
        """rows with the id's number; ids of another form that belong to no record go."""
        own = F.when(F.col(qid).rlike(_NUMBER), F.regexp_extract(qid, r"^Q(\d+)$", 1).cast("long"))
        if others is None:
            return rows.withColumn(name, own).where(F.col(name).isNotNull())
        return rows.join(others.select(F.col("qid").alias(qid), F.col("number").alias("__other")), qid, "left").withColumn(name, F.coalesce(own, "__other")).drop("__other").where(F.col(name).isNotNull())

    ids = numbered(recs.select("qid"), "qid", "target").select("target")
    arrays = F.array(*[F.struct(F.lit(i).alias("code"), F.col(p).alias("targets")) for i, p in enumerate(PARENT_PROPS)])
    wide = numbered(recs, "qid", "id").select("id", F.explode(arrays).alias("a")).select("id", "a.code", F.posexplode("a.targets").alias("pos", "t"))
    cand = storage.cut(numbered(wide.where("t is not null"), "t", "target").select("id", "code", "pos", "target"), "p2-candidates")
    real = skew.skew_semi_join(cand, ids, "target", skew.heavy_keys(cand, F.col("target"), 0.005))
    first = real.groupBy("id", "code").agg(F.min_by("target", "pos").alias("target"))
    return first.select((F.col("id") * 4 + F.col("code")).alias("node"), (F.col("target") * 4 + F.col("code")).alias("parent")), others


def _named(rows: DataFrame, others: DataFrame | None, **names: str) -> DataFrame:
    """rows with the ids of node columns, by the name each is to have."""
    for name, node in names.items():
        number = F.expr(f"{node} div 4")
        own = F.concat(F.lit("Q"), number.cast("string"))
        if others is None:
            rows = rows.withColumn(name, own)
        else:
            rows = rows.withColumn("__n", number).join(others.select(F.col("qid").alias("__q"), F.col("number").alias("__n")), "__n", "left").withColumn(name, F.coalesce("__q", own)).drop("__n", "__q")
    return rows


def _prop():
    return F.element_at(F.array(*[F.lit(p) for p in PARENT_PROPS]), (F.pmod("node", F.lit(4)) + 1).cast("int"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, others = parent_links(spark, sf_dir)
    return _named(hierarchy.hierarchy(links), others, qid="node", root_qid="root").select(_prop().alias("prop"), "qid", "root_qid", F.col("depth").alias("tree_depth"))


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything known of a node: parent, root, depth, interval, number of descendants, and its path as ids joined by >."""
    links, others = parent_links(spark, sf_dir)
    nodes = storage.cut(hierarchy.hierarchy(links), "p2-nodes")
    steps = hierarchy.paths(nodes)
    if others is None:
        path = steps.select("node", F.array_join(F.transform("path", lambda x: F.concat(F.lit("Q"), F.shiftright(x, 2).cast("string"))), ">").alias("path"))
    else:
        each = _named(steps.select("node", F.posexplode("path").alias("k", "step")), others, q="step")
        path = each.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]), ">").alias("path"))
    return _named(nodes.join(path, "node"), others, qid="node", parent_qid="parent", root_qid="root").select(
        _prop().alias("prop"), "qid", "parent_qid", "root_qid", F.col("depth").alias("tree_depth"), "on_cycle", "first_place", "last_place", "n_descendants", "path",
    )


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prop, qid, path): the part of p2_hierarchy that doesn't depend on the order of siblings."""
    return p2_hierarchy(spark, sf_dir).select("prop", "qid", "parent_qid", "on_cycle", "n_descendants", "path")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, others = parent_links(spark, sf_dir)
    nodes = storage.cut(hierarchy.hierarchy(links), "p2-nodes")
    return _named(hierarchy.descendants(nodes), others, qid="ancestor", descendant_qid="node").select(_prop().alias("prop"), "qid", "descendant_qid")


QUERIES |= {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_paths": p2_paths, "p2_descendants": p2_descendants}

_LINKS = rf"""{_RECORDS},
cand AS (SELECT prop, qid, claim_no, c->'mainsnak'->'datavalue'->'value'->>'id' AS t FROM claims WHERE prop IN ('P131', 'P171', 'P279')),
par AS MATERIALIZED (SELECT prop, qid, arg_min(t, claim_no) AS up FROM cand WHERE t IN (SELECT qid FROM recs) GROUP BY prop, qid),
nodes AS (SELECT prop, qid FROM par UNION SELECT prop, up FROM par),
climb AS (SELECT prop, qid, qid AS cur, 0 AS d FROM nodes UNION ALL
    SELECT climb.prop, climb.qid, par.up, d + 1 FROM climb JOIN par ON par.prop = climb.prop AND par.qid = climb.cur WHERE d < 1000),
on_cycle AS MATERIALIZED (SELECT DISTINCT prop, qid FROM climb WHERE d > 0 AND cur = qid),
ring AS (SELECT c.prop, c.qid, 'Q' || min(CAST(climb.cur[2:] AS BIGINT)) AS least FROM on_cycle c JOIN climb USING (prop, qid) GROUP BY ALL),
tops AS (SELECT prop, qid FROM nodes EXCEPT SELECT prop, qid FROM par UNION SELECT prop, qid FROM on_cycle),
tree AS (SELECT par.* FROM par ANTI JOIN on_cycle USING (prop, qid)),
hang AS (SELECT prop, qid AS top, qid, 0 AS d, qid AS path FROM tops UNION ALL
    SELECT t.prop, h.top, t.qid, h.d + 1, h.path || '>' || t.qid FROM hang h JOIN tree t ON t.prop = h.prop AND t.up = h.qid),
found AS (SELECT hang.prop, hang.qid, coalesce(least, top) AS root_qid, CASE WHEN d = 0 AND least IS NOT NULL THEN -1 ELSE d END AS tree_depth
    FROM hang LEFT JOIN ring ON ring.prop = hang.prop AND ring.qid = hang.top)"""
SQL |= {
    "p2_found": f"WITH RECURSIVE {_LINKS} SELECT * FROM found",
    "p2_paths": f"""WITH RECURSIVE {_LINKS}, below AS (SELECT t.prop, t.up AS qid, t.qid AS low FROM tree t UNION ALL SELECT b.prop, t.up, b.low FROM below b JOIN tree t ON t.prop = b.prop AND t.qid = b.qid)
        SELECT h.prop, h.qid, p.up AS parent_qid, h.d = 0 AND c.qid IS NOT NULL AS on_cycle, (SELECT count(*) FROM below b WHERE b.prop = h.prop AND b.qid = h.qid) AS n_descendants, h.path
        FROM hang h LEFT JOIN par p ON p.prop = h.prop AND p.qid = h.qid LEFT JOIN on_cycle c ON c.prop = h.prop AND c.qid = h.qid""",
    "p2_descendants": f"""WITH RECURSIVE {_LINKS}, pairs AS (SELECT prop, up AS qid, qid AS descendant_qid FROM tree UNION ALL
        SELECT p.prop, t.up, p.descendant_qid FROM pairs p JOIN tree t ON t.prop = p.prop AND t.qid = p.qid) SELECT * FROM pairs""",
}
