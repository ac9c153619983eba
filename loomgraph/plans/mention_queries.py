"""Queries of classification, counting, disambiguation, repair and type search over the model tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph import storage
from loomgraph.functions import text as X
from loomgraph.operators import classify as C
from loomgraph.operators import mentions as A
from loomgraph.operators import repair as L
from loomgraph.operators import search as T
from loomgraph.operators.graph import TypeGraph
from loomgraph.operators.heavy_keys import distinct_slots
from loomgraph.plans import model as M
from loomgraph.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
KIND_NAMES = ["award", "city", "country", "film", "human", "language", "occupation", "river", "sport", "taxon rank"]
STRUCTURAL = ["P31", "P279", "P361", "P131", "P171"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# -- sets and classes ----------------------------------------------------------------------------------------------------


def _edges(s, d) -> DataFrame:
    return storage.cut(M.edges(s, d), "edges")


def _kind(s, d, edges: DataFrame, *kinds: str) -> DataFrame:
    """(entity): instances of core entities of the given kinds."""
    core = table(s, d, "core_entities").where(F.col("kind_name").isin(list(kinds))).select(F.col("entity").cast("long").alias("parent"))
    return edges.where("prop = 'P31'").join(core, "parent", "left_semi").select(F.col("child").alias("entity")).distinct()


def _located(edges: DataFrame) -> DataFrame:
    return edges.where("prop = 'P131'").select(F.col("child").alias("entity")).distinct()


def _all(s, d) -> DataFrame:
    return M.entities(s, d).select("entity").distinct()


def _kind_classes(s, d, edges: DataFrame) -> DataFrame:
    return C.export(_all(s, d), {k: _kind(s, d, edges, k) for k in KIND_NAMES})


KINDS = """kinds AS MATERIALIZED (SELECT DISTINCT e.child AS entity, kind_name AS kind FROM edges e JOIN core_entities c ON c.entity = e.parent WHERE prop = 'P31'),
located AS (SELECT DISTINCT child AS entity FROM edges WHERE prop = 'P131'),
every AS (SELECT DISTINCT entity FROM entities),
names AS (SELECT unnest(['award','city','country','film','human','language','occupation','river','sport','taxon rank']) AS kind, unnest(range(10)) AS k),
exported AS MATERIALIZED (SELECT e.entity, CAST(coalesce(max(n.k), 10) AS INTEGER) AS class_id FROM every e LEFT JOIN kinds USING (entity) LEFT JOIN names n USING (kind) GROUP BY e.entity)"""
_K = f"WITH {M.EDGES}, {KINDS}"

query("class_lookup", f"{_K} SELECT x.entity, class_id FROM exported x JOIN located USING (entity)")(lambda s, d: (lambda e: _kind_classes(s, d, e).join(_located(e), "entity").select("entity", "class_id"))(_edges(s, d)))
query("classification_export", f"{_K} SELECT entity, class_id, coalesce(kind, 'other') AS label FROM exported LEFT JOIN names ON k = class_id")(lambda s, d: _kind_classes(s, d, _edges(s, d)))
query("bool_algebra", f"{_K} SELECT entity FROM kinds WHERE kind IN ('city', 'river') INTERSECT SELECT entity FROM located")(
    lambda s, d: (lambda e: C.all_of(C.any_of(_kind(s, d, e, "city"), _kind(s, d, e, "river")), _located(e)))(_edges(s, d))
)
query("bool_nary", f"{_K} SELECT DISTINCT entity FROM kinds WHERE kind IN ('city', 'river', 'country', 'film')")(
    lambda s, d: (lambda e: C.any_of(*[_kind(s, d, e, k) for k in ("city", "river", "country", "film")]))(_edges(s, d))
)
query("bool_negate", f"{_K} SELECT entity FROM located EXCEPT SELECT entity FROM kinds WHERE kind IN ('city', 'country')")(
    lambda s, d: (lambda e: C.none_of(_located(e), _kind(s, d, e, "city"), _kind(s, d, e, "country")))(_edges(s, d))
)
query("other_class", f"{_K} SELECT entity FROM every EXCEPT (SELECT entity FROM kinds UNION SELECT entity FROM located)")(
    lambda s, d: (lambda e: C.other(_all(s, d), _kind(s, d, e, *KIND_NAMES), _located(e)))(_edges(s, d))
)
query("set_union", f"{_K} SELECT entity FROM located UNION SELECT entity FROM kinds WHERE kind = 'human'")(lambda s, d: (lambda e: _located(e).union(_kind(s, d, e, "human")).distinct())(_edges(s, d)))
query("set_intersect", f"{_K} SELECT entity FROM located INTERSECT SELECT entity FROM kinds WHERE kind = 'human'")(lambda s, d: (lambda e: _located(e).intersect(_kind(s, d, e, "human")))(_edges(s, d)))
query("set_except", f"{_K} SELECT entity FROM located EXCEPT SELECT entity FROM kinds WHERE kind = 'human'")(lambda s, d: (lambda e: _located(e).subtract(_kind(s, d, e, "human")))(_edges(s, d)))
query("binary_classifications", f"{_K} SELECT entity, CASE WHEN entity IN (SELECT entity FROM located) THEN 'Y' ELSE 'N' END AS label FROM every")(lambda s, d: C.binary(_all(s, d), _located(_edges(s, d))))
_FIRST = f"WITH {M._RECORDS}, {M.ENTITIES}, {M.DATES}, first AS (SELECT prop, entity, arg_min(year, pos) AS year FROM dates GROUP BY ALL), every AS (SELECT DISTINCT entity FROM entities)"
query("attr_compare", f"{_FIRST} SELECT e.entity, coalesce(year < 1500, false) AS early, NOT coalesce(year < 1500, false) AS not_early FROM every e LEFT JOIN (SELECT * FROM first WHERE prop = 'P569') f USING (entity)")(
    lambda s, d: _all(s, d).join(M.dates(s, d).where("prop = 'P569'").groupBy("entity").agg(F.min_by("year", "pos").alias("year")), "entity", "left").select("entity", C.compare(F.col("year"), "<", 1500).alias("early"), (~C.compare(F.col("year"), "<", 1500)).alias("not_early"))
)


# fixed values: the dates that tell how old something is, and the year between the classes
DATED, DATED_YEAR = ["P577", "P569", "P571", "P576", "P585", "P580"], 1950


@query("time_classifier", f"{_FIRST}, f AS (SELECT entity, max(year < 1950) AS b, max(year >= 1950) AS a FROM first WHERE prop IN ('P577', 'P569', 'P571', 'P576', 'P585', 'P580') GROUP BY entity) SELECT entity, CASE WHEN b THEN 'pre-1950' WHEN a THEN 'post-1950' ELSE 'other' END AS label FROM every LEFT JOIN f USING (entity)")
def time_classifier(s, d) -> DataFrame:
    before, after = C.by_time(storage.cut(M.dates(s, d), "dates"), DATED, DATED_YEAR)
    return C.export(_all(s, d), {"pre-1950": before, "post-1950": after}).select("entity", "label")


@query("rules_classifier", f"""WITH RECURSIVE {M.EDGES}, {KINDS}, roots AS (SELECT CAST(entity AS BIGINT) AS root, kind_name AS kind FROM core_entities WHERE kind_name IN ('city', 'human', 'film')),
walk AS (SELECT kind, root AS entity FROM roots UNION SELECT w.kind, e.child FROM walk w JOIN edges e ON e.parent = w.entity AND e.prop IN ('P31', 'P279')),
city AS (SELECT entity FROM walk WHERE kind = 'city'), human AS (SELECT entity FROM walk WHERE kind = 'human' EXCEPT SELECT entity FROM city), film AS (SELECT entity FROM walk WHERE kind = 'film' EXCEPT (SELECT entity FROM city UNION SELECT entity FROM walk WHERE kind = 'human'))
SELECT entity, CASE WHEN entity IN (SELECT entity FROM human) THEN 'human' WHEN entity IN (SELECT entity FROM film) THEN 'film' WHEN entity IN (SELECT entity FROM city) THEN 'city' ELSE 'other' END AS label FROM every""")
def rules_classifier(s, d) -> DataFrame:
    """A classification from rules as data: all closures in one batched loop, exclusivity by negation."""
    from loomgraph.operators.graph import Rule

    core = table(s, d, "core_entities").where("kind_name in ('city', 'human', 'film')").select("entity", "kind_name").collect()  # a fixed list of at most 300
    names = ("city", "human", "film")
    rules = [Rule(k, ("P31", "P279"), tuple(r["entity"] for r in core if r["kind_name"] == n)) for k, n in enumerate(names)]
    got = storage.cut(TypeGraph(_edges(s, d)).closures(rules), "rules")
    city, human, film = (got.where(F.col("rule_id") == k).select("entity") for k in range(3))
    return C.export(_all(s, d), {"city": city, "human": C.none_of(human, city), "film": C.none_of(film, city, human)}).select("entity", "label")


query("class_cardinality", f"{_K} SELECT coalesce(kind, 'other') AS label, count(*) AS n, array_to_string(list_sort(list(entity))[1:20], ',') AS first_members FROM exported LEFT JOIN names ON k = class_id GROUP BY 1")(
    lambda s, d: C.cardinality(_kind_classes(s, d, _edges(s, d)).select("entity", "label")).withColumn("first_members", F.array_join(F.col("first_members").cast("array<string>"), ","))
)
_REPORT = "SELECT prop, parent, n, round(100.0 * n / (SELECT count(*) FROM members), 6) AS percent FROM (SELECT prop, parent, count(*) AS n, row_number() OVER (PARTITION BY prop ORDER BY count(*) DESC, parent) AS k FROM edges WHERE child IN (SELECT entity FROM members) AND prop IN ('P31', 'P131', 'P279') GROUP BY prop, parent) WHERE k <= 20"
query("class_report", f"{_K}, members AS (SELECT DISTINCT entity FROM kinds WHERE kind = 'city') {_REPORT}")(lambda s, d: (lambda e: C.report(_kind(s, d, e, "city"), e, ["P31", "P131", "P279"]))(_edges(s, d)))
query("class_report_fixed_points", f"{_K} SELECT DISTINCT entity FROM kinds WHERE kind = 'city' AND (entity IN (SELECT child FROM edges WHERE prop = 'P361') OR entity IN (SELECT parent FROM edges WHERE prop = 'P361'))")(
    lambda s, d: (lambda e: C.all_of(_kind(s, d, e, "city"), C.any_of(*[e.where("prop = 'P361'").select(F.col(c).alias("entity")) for c in ("child", "parent")])))(_edges(s, d))
)
query("nonconstant_types", f"{_K} SELECT parent AS type, count(DISTINCT child) AS n FROM edges WHERE prop = 'P31' GROUP BY parent HAVING count(DISTINCT child) BETWEEN 2 AND (SELECT count(*) FROM every) - 1")(
    lambda s, d: M.edges(s, d).where("prop = 'P31'").select("parent", "child").distinct().groupBy(F.col("parent").alias("type")).agg(F.count("*").alias("n")).where("n >= 2").where(F.col("n") <= _all(s, d).agg(F.count("*") - 1).scalar())
)

# -- counts ----------------------------------------------------------------------------------------------------------------

_D = f"WITH {M.DICTIONARY}"
MENTIONS = "mentions AS MATERIALIZED (SELECT surface_id, entity, count(*) AS n FROM slots WHERE entity >= 0 AND cnt IS NOT NULL GROUP BY ALL)"


def _mentions(s, d) -> DataFrame:
    return distinct_slots(table(s, d, "surface_dictionary")).where("entity >= 0 and cnt is not null").groupBy(F.col("trie_index").alias("surface_id"), "entity").agg(F.count("*").alias("n"))


def _dictionary(s, d) -> DataFrame:
    return storage.cut(M.dictionary(s, d), "dictionary")


query("dictionary_counts", f"{_D} SELECT * FROM dictionary")(lambda s, d: M.dictionary(s, d))
query("dictionary_deleted", f"{_D} SELECT surface_id, coalesce(entity, -1) AS entity, count(*) AS n FROM slots GROUP BY ALL")(
    lambda s, d: distinct_slots(table(s, d, "surface_dictionary")).groupBy(F.col("trie_index").alias("surface_id"), F.coalesce("entity", F.lit(-1)).cast("long").alias("entity")).agg(F.count("*").alias("n"))
)
query("candidate_lookup", f"{_D} SELECT m.surface_id, m.entity, m.cnt FROM dictionary m WHERE surface_id IN (SELECT surface_id FROM slots WHERE cnt > 50)")(
    lambda s, d: M.dictionary(s, d).join(distinct_slots(table(s, d, "surface_dictionary")).where("cnt > 50").select(F.col("trie_index").alias("surface_id")).distinct(), "surface_id", "left_semi")
)
query("slot_diagnostics", f"{_D} SELECT count(*) AS n_slots, count(*) FILTER (entity IS NULL) AS no_entity, count(*) FILTER (entity = -1) AS deleted, count(*) FILTER (cnt IS NULL) AS no_count FROM slots")(
    lambda s, d: distinct_slots(table(s, d, "surface_dictionary")).agg(F.count("*").alias("n_slots"), F.count_if(F.expr("entity is null")).alias("no_entity"), F.count_if(F.expr("entity = -1")).alias("deleted"), F.count_if(F.expr("cnt is null")).alias("no_count"))
)
query("weighted_popularity", f"{_D}, {M.ENTITIES} SELECT e.entity, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS weight FROM (SELECT DISTINCT entity FROM entities) e LEFT JOIN dictionary USING (entity) GROUP BY e.entity")(
    lambda s, d: _all(s, d).join(M.dictionary(s, d).groupBy("entity").agg(F.sum("cnt").alias("w")), "entity", "left").select("entity", F.coalesce("w", F.lit(0)).cast("long").alias("weight"))
)
query("top_class_members", f"{_K}, {M.DICTIONARY} SELECT entity, CAST(sum(cnt) AS BIGINT) AS weight FROM dictionary WHERE entity IN (SELECT entity FROM kinds WHERE kind = 'city') GROUP BY entity ORDER BY weight DESC, entity LIMIT 20")(
    lambda s, d: M.dictionary(s, d).join(_kind(s, d, _edges(s, d), "city"), "entity", "left_semi").groupBy("entity").agg(F.sum("cnt").alias("weight")).orderBy(F.desc("weight"), "entity").limit(20)
)
@query(
    "type_proposals",
    f"WITH {M.EDGES}, {M.PAGES}, {M.DICTIONARY}, corpus AS (SELECT DISTINCT entity FROM dictionary), "
    + r"cats AS (SELECT DISTINCT page_qid, split_part(split_part(x, '|', 1), ':', -1) AS title FROM (SELECT page_qid, unnest(regexp_extract_all(text, '\[\[((?:Category|Catégorie|Categorie|Categoría|Categoria|Kategorie|Kategoria|Категория|Kategori):[^\]\[]*)\]\]', 1)) AS x FROM documents)), "
    "fixed AS (SELECT title, min(entity) AS type FROM (SELECT leaf_text AS title, qid FROM leaves WHERE leaf_kind = 'sitelink' UNION ALL SELECT title, article_qid FROM pages WHERE title IS NOT NULL) JOIN entities USING (qid) GROUP BY title), "
    "own AS (SELECT DISTINCT 'P31' AS relation, parent AS type, child FROM edges WHERE prop = 'P31' UNION SELECT 'category', type, entity FROM cats JOIN fixed ON fixed.title = trim(cats.title) JOIN entities ON qid = page_qid) "
    "SELECT relation, type, count(*) AS n, round(CAST('0x' || substr(md5(type || '|' || relation || '|1'), 1, 8) AS BIGINT) / 4294967296.0, 9) AS draw FROM own WHERE child IN (SELECT entity FROM corpus) GROUP BY relation, type",
)
def type_proposals(s, d) -> DataFrame:
    """(relation, type, n, draw): targets of instance-of, and categories' main articles, by how many entities of the corpus have them; draw shuffles them."""
    return A.proposals(M.edges(s, d), _category_links(s, d), M.dictionary(s, d).select("entity").distinct(), seed=1).withColumn("draw", F.round("draw", 9))


def _category_links(s, d) -> DataFrame:
    """(child, parent): entities of pages and the main articles of their categories."""
    cats = table(s, d, "documents").select("page_qid", F.explode(X.categories(F.col("text"))).alias("c")).select(F.col("page_qid").alias("qid"), F.trim(F.substring_index("c", ":", -1)).alias("title")).distinct()
    fixed = M.titles(s, d).groupBy("title").agg(F.min("entity").alias("parent"))
    return cats.join(fixed, "title").join(M.entities(s, d), "qid").select(F.col("entity").alias("child"), "parent").distinct()


query("id_compaction", f"{_D} SELECT entity, CAST(dense_rank() OVER (ORDER BY entity) - 1 AS BIGINT) AS dense FROM (SELECT DISTINCT entity FROM dictionary)")(lambda s, d: T.compact(M.dictionary(s, d).select("entity").distinct()))

# -- disambiguation --------------------------------------------------------------------------------------------------------

OUTCOMES = f"""{M.EDGES}, {KINDS}, {M.DICTIONARY}, {MENTIONS},
cand AS MATERIALIZED (SELECT d.*, CASE WHEN x.class_id = 10 THEN -1 ELSE coalesce(x.class_id, -1) END AS c0, CASE WHEN l.entity IS NULL THEN -1 ELSE 0 END AS c1
    FROM dictionary d LEFT JOIN exported x USING (entity) LEFT JOIN located l ON l.entity = d.entity),
flags AS (SELECT surface_id, max(c0 = -1) AS a0, max(c1 = -1) AS a1, count(*) AS n_all, first(entity ORDER BY cnt DESC, entity) AS prior FROM cand GROUP BY surface_id),
pairs AS (SELECT t.surface_id, t.entity, t.cnt AS own, x.cnt, t.c0 = x.c0 AND t.c1 = x.c1 AS strict, (t.c0 = x.c0 OR a0) AND (t.c1 = x.c1 OR a1) AS ign,
    (t.c0 = x.c0 OR t.c0 = -1 OR x.c0 = -1) AND (t.c1 = x.c1 OR t.c1 = -1 OR x.c1 = -1) AS keep
    FROM cand t JOIN flags USING (surface_id) JOIN cand x ON x.surface_id = t.surface_id WHERE (t.surface_id, t.entity) IN (SELECT surface_id, entity FROM mentions)),
lists AS (SELECT surface_id, entity, own, list_sort(list(cnt) FILTER (strict), 'DESC') AS s, list_sort(list(cnt) FILTER (ign), 'DESC') AS i, list_sort(list(cnt) FILTER (keep), 'DESC') AS k FROM pairs GROUP BY ALL),
outcomes AS MATERIALIZED (SELECT m.surface_id, m.entity, m.n, n_all, prior, n_all = 1 AS obvious, prior = m.entity AS greedy,
    len(s) <= 1 AS strict, len(s) <= 1 OR (s[1] > s[2] AND own = s[1]) AS strict_counts, len(i) <= 1 AS ignore_other, len(i) <= 1 OR (i[1] > i[2] AND own = i[1]) AS ignore_other_counts,
    len(k) <= 1 AS keep_other, len(k) <= 1 OR (k[1] > k[2] AND own = k[1]) AS keep_other_counts FROM mentions m JOIN lists USING (surface_id, entity) JOIN flags USING (surface_id))"""


def _outcomes(s, d) -> DataFrame:
    edges = _edges(s, d)
    kinds = _kind_classes(s, d, edges).where("label <> 'other'")
    return A.outcomes(_mentions(s, d), _dictionary(s, d), [kinds, _located(edges).withColumn("class_id", F.lit(0))], -1)


_O = f"WITH {OUTCOMES}"
for _name, _columns in {"obvious_ambiguous": ["obvious"], "greedy_disambiguate": ["greedy"], "oracle_strict": ["strict"], "oracle_ignore_other": ["ignore_other"], "oracle_keep_other": ["keep_other"], "oracle_counts": ["strict_counts", "ignore_other_counts", "keep_other_counts"]}.items():
    query(_name, f"{_O} SELECT surface_id, entity, n, {', '.join(_columns)} FROM outcomes")(lambda s, d, c=_columns: _outcomes(s, d).select("surface_id", "entity", "n", *c))
_SUMS = ", ".join(f"CAST(coalesce(sum(n) FILTER (NOT obvious AND {c}), 0) AS BIGINT) AS {a}" for c, a in (("greedy", "greedy"), ("strict", "oracle"), ("strict_counts", "oracle_counts"), ("ignore_other_counts", "oracle_ignore_other"), ("keep_other_counts", "oracle_keep_other")))
REPORT = f"report AS (SELECT CAST(coalesce(sum(n) FILTER (NOT obvious), 0) AS BIGINT) AS ambiguous, CAST(coalesce(sum(n) FILTER (obvious), 0) AS BIGINT) AS obvious, {_SUMS} FROM outcomes)"
query("disambiguation_report", f"{_O}, {REPORT} SELECT * FROM report")(lambda s, d: A.report(_outcomes(s, d)))
_METHODS = ("greedy", "oracle", "oracle_counts", "oracle_ignore_other", "oracle_keep_other")
query("disambiguation_percent", f"{_O}, {REPORT} SELECT " + ", ".join(f"round(100.0 * {m} / ambiguous, 6) AS {m}, round(100.0 * ({m} + obvious) / (ambiguous + obvious), 6) AS {m}_all" for m in _METHODS) + " FROM report")(lambda s, d: A.percentages(A.report(_outcomes(s, d))))
query("min_count_percent", f"{_D} SELECT surface_id, entity, cnt, round(100.0 * cnt / sum(cnt) OVER (PARTITION BY surface_id), 6) AS percent FROM dictionary QUALIFY cnt >= 3 AND 100.0 * cnt / sum(cnt) OVER (PARTITION BY surface_id) >= 5")(
    lambda s, d: A.with_share(_dictionary(s, d)).where("cnt >= 3 and 100.0 * cnt / total >= 5").select("surface_id", "entity", "cnt", "percent")
)
query(
    "ambiguity_report",
    f"{_O}, bad AS (SELECT coalesce(kind, 'other') AS label, surface_id, CAST(sum(n) AS BIGINT) AS surface_n FROM outcomes JOIN exported USING (entity) LEFT JOIN names ON k = class_id WHERE NOT obvious AND NOT strict GROUP BY ALL), "
    "r AS (SELECT *, CAST(sum(surface_n) OVER (PARTITION BY label) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY label ORDER BY surface_n DESC, surface_id) AS INTEGER) AS k FROM bad) SELECT label, n, surface_id, surface_n, k FROM r WHERE k <= 6",
)(lambda s, d: A.ambiguity(_outcomes(s, d), "strict", _kind_classes(s, d, _edges(s, d)).select("entity", "label")))
query("mention_counts", f"{_D}, {MENTIONS} SELECT m.surface_id, m.entity, m.n, d.cnt FROM mentions m JOIN dictionary d USING (surface_id, entity)")(lambda s, d: _mentions(s, d).join(M.dictionary(s, d), ["surface_id", "entity"]).select("surface_id", "entity", "n", "cnt"))

# -- repair ----------------------------------------------------------------------------------------------------------------


def _promoted(s, d) -> DataFrame:
    e = _edges(s, d)
    rows = L.flag(L.flag(L.start(_dictionary(s, d)), _kind(s, d, e, "human", "film"), "cond"), _kind(s, d, e, "city", "country", "river"), "alt")
    return L.promote(rows, F.col("cond"), F.col("alt")).select("surface_id", "old_entity", "cnt", "entity")


PROMOTED = f"""{M.EDGES}, {KINDS}, {M.DICTIONARY}, cond AS (SELECT DISTINCT entity FROM kinds WHERE kind IN ('human', 'film')), alt AS (SELECT DISTINCT entity FROM kinds WHERE kind IN ('city', 'country', 'river')),
best AS (SELECT surface_id, first(entity ORDER BY cnt DESC, entity) AS b, max(cnt) AS bc FROM dictionary WHERE entity IN (SELECT entity FROM alt) GROUP BY surface_id),
promoted AS MATERIALIZED (SELECT d.surface_id, d.entity AS old_entity, d.cnt, CASE WHEN bc IS NOT NULL AND d.cnt < bc AND d.entity IN (SELECT entity FROM cond) THEN CASE WHEN bc > 5 THEN b END ELSE d.entity END AS entity FROM dictionary d LEFT JOIN best USING (surface_id)),
reduced AS MATERIALIZED (SELECT surface_id, entity, CAST(sum(cnt) AS BIGINT) AS cnt FROM promoted WHERE entity IS NOT NULL GROUP BY ALL)"""
_P = f"WITH {PROMOTED}"
query("promote_highest", f"{_P} SELECT * FROM promoted")(_promoted)
query("keep_high", f"{_D} SELECT surface_id, entity, cnt, max(cnt) OVER (PARTITION BY surface_id) > cnt OR (max(cnt) OVER (PARTITION BY surface_id) > 50 AND max(cnt) OVER (PARTITION BY surface_id) >= 0.8 * cnt) AS may FROM dictionary")(
    lambda s, d: (lambda x: x.join(x.groupBy("surface_id").agg(F.max("cnt").alias("top")), "surface_id").select("surface_id", "entity", "cnt", L.keep_high(F.col("cnt"), F.col("top")).alias("may")))(_dictionary(s, d))
)
query("reduce_values", f"{_P} SELECT * FROM reduced")(lambda s, d: L.reduce_values(_promoted(s, d)))
_ANCHORED = "SELECT child FROM edges WHERE prop IN ('P31', 'P279', 'P361', 'P131', 'P171')"
query("surface_prune", f"WITH {M.EDGES}, {M.DICTIONARY} SELECT surface_id FROM dictionary GROUP BY surface_id HAVING NOT bool_or(entity IN ({_ANCHORED}))")(
    lambda s, d: L.emptied(L.drop(L.flag(L.start(M.dictionary(s, d)), M.edges(s, d).where(F.col("prop").isin(STRUCTURAL)).select(F.col("child").alias("entity")), "anchored"), ~F.col("anchored")))
)
query("fix_change_stats", f"{_P} SELECT count(*) FILTER (old_entity IS DISTINCT FROM entity) AS n_changed, CAST(coalesce(sum(cnt) FILTER (old_entity IS DISTINCT FROM entity), 0) AS BIGINT) AS changed_volume, count(*) FILTER (entity IS NULL) AS n_deleted FROM promoted")(lambda s, d: L.change_stats(_promoted(s, d)))
query("surface_rekey", f"{_P} SELECT r.surface_id, dense_rank() OVER (ORDER BY r.surface_id) - 1 AS new_id, r.entity, r.cnt FROM reduced r")(
    lambda s, d: (lambda r: r.join(T.compact(r.select(F.col("surface_id").alias("entity")).distinct()).select(F.col("entity").alias("surface_id"), F.col("dense").alias("new_id")), "surface_id"))(storage.cut(L.reduce_values(_promoted(s, d)), "reduced"))
)
query("apply_transitions", f"{_P}, {MENTIONS} SELECT m.surface_id, m.entity AS old_entity, CASE WHEN r.entity IS NULL THEN -1 ELSE p.entity END AS entity, m.n FROM mentions m LEFT JOIN promoted p ON p.surface_id = m.surface_id AND p.old_entity = m.entity LEFT JOIN reduced r ON r.surface_id = p.surface_id AND r.entity = p.entity")(
    lambda s, d: (lambda p: A.apply_transitions(_mentions(s, d), L.transitions(p), L.reduce_values(p)))(storage.cut(_promoted(s, d), "promoted"))
)
LENGTHS = "lengths AS (SELECT trie_index AS surface_id, min(length(surface)) AS length FROM surface_dictionary GROUP BY trie_index)"


def _lengths(s, d) -> DataFrame:
    return table(s, d, "surface_dictionary").groupBy(F.col("trie_index").alias("surface_id")).agg(F.min(F.length("surface")).alias("length"))


def _short(rows: DataFrame) -> F.Column:
    """What the length rule deletes: surfaces of one character, short ones of sports and the like, and all episodes."""
    return (F.col("length") < 2) | (F.col("short_lived") & (F.col("length") <= 2)) | F.col("episode")


@query("short_surface_drop", f"WITH {M.EDGES}, {KINDS}, {M.DICTIONARY}, {LENGTHS} SELECT d.surface_id, d.entity AS old_entity, CASE WHEN length < 2 OR (length <= 2 AND d.entity IN (SELECT entity FROM kinds WHERE kind = 'sport')) OR d.entity IN (SELECT entity FROM kinds WHERE kind = 'taxon rank') THEN NULL ELSE d.entity END AS entity FROM dictionary d LEFT JOIN lengths USING (surface_id)")
def short_surface_drop(s, d) -> DataFrame:
    e = _edges(s, d)
    rows = L.start(M.dictionary(s, d)).join(_lengths(s, d), "surface_id", "left")
    rows = L.flag(L.flag(rows, _kind(s, d, e, "sport"), "short_lived"), _kind(s, d, e, "taxon rank"), "episode")
    return L.drop(rows, _short(rows)).select("surface_id", "old_entity", "entity")


query("orphan_candidate_drop", f"WITH {M.EDGES}, {M.DICTIONARY} SELECT surface_id, entity AS old_entity, CASE WHEN entity IN (SELECT child FROM edges WHERE prop IN ('P31', 'P279', 'P361', 'P131', 'P171')) THEN entity END AS entity FROM dictionary")(
    lambda s, d: L.drop(L.flag(L.start(M.dictionary(s, d)), M.edges(s, d).where(F.col("prop").isin(STRUCTURAL)).select(F.col("child").alias("entity")), "anchored"), L.unchanged() & ~F.col("anchored")).select("surface_id", "old_entity", "entity")
)
# fixed values: the typed paths by which a candidate may move, (relation, hops) steps and whether the path promotes whatever the counts are;
# relations that the edges lack (here P1269, P39, P179, P276, P301, P360 and those of categories) are passed over
PATHS = [
    ([("P31", 1)], False), ([("P31", 1), ("P279", 2)], False), ([("P31", 1), ("P1269", 1)], False), ([("P279", 3)], False), ([("P106", 1)], True), ([("P39", 1)], True),
    ([("P361", 1), ("P31", 1)], False), ([("P179", 1), ("P31", 1)], False), ([("P179", 1), ("P276", 1)], False), ([("P131", 1)], False), ([("P17", 1)], False),
    ([("category", 1), ("P301", 1)], False), ([("category", 8), ("fixed_point", 1)], False), ([("category", 1), ("fixed_point", 1), ("P360", 1)], False), ([("P360", 1), ("P279", 2)], False),
]


def _extended(s, d) -> DataFrame:
    e = _edges(s, d)
    rows = L.flag(L.start(_dictionary(s, d)), _kind(s, d, e, "human"), "people")
    return L.extend(rows, ~F.col("people"), TypeGraph(e), PATHS).select("surface_id", "old_entity", "cnt", "entity")


REACH = """rel AS MATERIALIZED (SELECT DISTINCT prop, child AS a, parent AS o FROM edges), c1 AS MATERIALIZED (SELECT a, o FROM rel WHERE prop = 'P279'), c2 AS MATERIALIZED (SELECT DISTINCT x.a, y.o FROM c1 x JOIN c1 y ON y.a = x.o),
c3 AS (SELECT DISTINCT x.a, y.o FROM c2 x JOIN c1 y ON y.a = x.o), up AS (SELECT * FROM c1 UNION SELECT * FROM c2),
reach AS MATERIALIZED (SELECT a, o, max(p) AS p FROM (SELECT a, o, prop = 'P106' AS p FROM rel WHERE prop IN ('P31', 'P131', 'P17', 'P106') UNION ALL SELECT a, o, false FROM up UNION ALL SELECT a, o, false FROM c3
    UNION ALL SELECT r.a, u.o, false FROM rel r JOIN up u ON u.a = r.o WHERE r.prop = 'P31' UNION ALL SELECT x.a, y.o, false FROM rel x JOIN rel y ON y.a = x.o WHERE x.prop = 'P361' AND y.prop = 'P31') WHERE a <> o GROUP BY a, o)"""
EXTENDED = f"""{M.EDGES}, {KINDS}, {M.DICTIONARY}, {REACH},
hits AS (SELECT j.surface_id, j.entity, o.entity AS other, o.cnt FROM dictionary j JOIN reach ON a = j.entity JOIN dictionary o ON o.surface_id = j.surface_id AND o.entity = reach.o
    WHERE o.entity NOT IN (SELECT entity FROM kinds WHERE kind = 'human') AND (p OR o.cnt > j.cnt OR (o.cnt > 50 AND o.cnt >= 0.8 * j.cnt))),
best AS (SELECT surface_id, entity, first(other ORDER BY cnt DESC, other) AS b, max(cnt) AS bc FROM hits GROUP BY ALL),
extended AS (SELECT d.surface_id, d.entity AS old_entity, d.cnt, CASE WHEN b IS NULL THEN d.entity WHEN bc > 5 THEN b END AS entity FROM dictionary d LEFT JOIN best USING (surface_id, entity))"""
query("extend_relations", f"WITH {EXTENDED} SELECT * FROM extended")(_extended)


def _masks(s, d, e: DataFrame) -> dict[str, DataFrame]:
    kind = lambda *k: _kind(s, d, e, *k)
    return {
        "aspect": kind("award"), "people": kind("human"), "history": kind("film"), "episode": kind("taxon rank"), "kin": kind("occupation"), "protected": kind("country", "city", "language"),
        "cardinal": kind("river"), "country": kind("country"), "political": kind("city"), "short_lived": kind("sport"), "anchored": e.where(F.col("prop").isin(STRUCTURAL)).select(F.col("child").alias("entity")).distinct(),
    }


def _pass(s, d):
    e = _edges(s, d)
    masks = {k: storage.cut(m, f"mask-{k}") for k, m in _masks(s, d, e).items()}
    lengths = storage.cut(_lengths(s, d), "lengths")
    return lambda dictionary: L.fix_pass(dictionary, TypeGraph(e), masks, lengths, PATHS)


def _sql_promote(at: str, to: str, cond: str, alt: str) -> str:
    return f"""b_{to} AS (SELECT surface_id, first(entity ORDER BY cnt DESC, entity) AS b, max(cnt) AS bc FROM {at} WHERE entity IS NOT NULL AND {alt} GROUP BY surface_id),
{to} AS MATERIALIZED (SELECT x.surface_id, old_entity, cnt, length, CASE WHEN bc IS NOT NULL AND cnt < bc AND entity IS NOT NULL AND {cond} THEN CASE WHEN bc > 5 THEN b END ELSE entity END AS entity FROM {at} x LEFT JOIN b_{to} USING (surface_id))"""


def _in(*kinds: str) -> str:
    return "coalesce(entity IN (SELECT entity FROM kinds WHERE kind IN (" + ", ".join(f"'{k}'" for k in kinds) + ")), false)"


_SAME = "coalesce(entity = old_entity, false)"
FIXED = f"""{M.EDGES}, {KINDS}, {M.DICTIONARY}, {LENGTHS},
s0 AS MATERIALIZED (SELECT d.surface_id, d.entity AS old_entity, d.cnt, d.entity, length FROM dictionary d LEFT JOIN lengths USING (surface_id)),
{_sql_promote("s0", "s1", _in("award"), _in("human"))},
{_sql_promote("s1", "s2", f"{_in('film')} AND {_SAME}", f"NOT {_in('film')}")},
s3 AS MATERIALIZED (SELECT surface_id, old_entity, cnt, length, CASE WHEN coalesce(length < 2, false) OR ({_in("sport")} AND coalesce(length <= 2, false)) OR {_in("taxon rank")} THEN NULL ELSE entity END AS entity FROM s2),
{REACH},
alts AS (SELECT surface_id, entity, max(cnt) AS cnt FROM s3 WHERE entity IS NOT NULL AND NOT {_in("human")} GROUP BY ALL),
best AS (SELECT j.surface_id, j.old_entity, first(o.entity ORDER BY o.cnt DESC, o.entity) AS b, max(o.cnt) AS bc FROM s3 j JOIN reach ON a = j.entity JOIN alts o ON o.surface_id = j.surface_id AND o.entity = reach.o WHERE p OR o.cnt > j.cnt OR (o.cnt > 50 AND o.cnt >= 0.8 * j.cnt) GROUP BY ALL),
s4 AS (SELECT x.surface_id, x.old_entity, cnt, length, CASE WHEN b IS NULL THEN entity WHEN bc > 5 THEN b END AS entity FROM s3 x LEFT JOIN best USING (surface_id, old_entity)),
s5 AS MATERIALIZED (SELECT surface_id, old_entity, cnt, length, CASE WHEN {_SAME} AND entity NOT IN (SELECT child FROM edges WHERE prop IN ('P31', 'P279', 'P361', 'P131', 'P171')) THEN NULL ELSE entity END AS entity FROM s4),
{_sql_promote("s5", "s6", _in("human"), _in("occupation"))},
{_sql_promote("s6", "s7", f"NOT {_in('country', 'city', 'language')} AND cnt < 100 AND {_SAME}", _in("river"))},
{_sql_promote("s7", "s8", f"NOT {_in('country', 'city', 'language')} AND cnt < 100 AND {_SAME}", _in("country"))},
{_sql_promote("s8", "s9", f"NOT {_in('country', 'city', 'language')} AND cnt < 100 AND {_SAME}", _in("city"))}"""
_FREE = f"NOT {_in('country', 'city', 'language')} AND cnt < 100 AND {_SAME}"


@query("country_promotion", f"WITH {M.EDGES}, {KINDS}, {M.DICTIONARY}, s0 AS (SELECT surface_id, entity AS old_entity, cnt, entity, 0 AS length FROM dictionary), {_sql_promote('s0', 's1', _FREE, _in('river'))}, {_sql_promote('s1', 's2', _FREE, _in('country'))}, {_sql_promote('s2', 's3', _FREE, _in('city'))} SELECT surface_id, old_entity, entity FROM s3")
def country_promotion(s, d) -> DataFrame:
    """Unprotected rows below 100 that are still what they were: to cardinal, then country, then political."""
    masks = _masks(s, d, _edges(s, d))
    return L.promote_places(storage.cut(L.start(_dictionary(s, d)), "stage"), masks).select("surface_id", "old_entity", "entity")


query("fix_pass", f"WITH {FIXED} SELECT surface_id, old_entity, cnt, entity FROM s9")(lambda s, d: _pass(s, d)(_dictionary(s, d)))
def _sql_passes(n: int) -> str:
    """The stages of n passes one after another: pass k reads dictionary_k and its last stage is s9_k."""
    first = FIXED[: FIXED.index("s0 AS MATERIALIZED")] + REACH
    body = FIXED[FIXED.index("s0 AS MATERIALIZED") :].replace(REACH + ",", "")
    out = [first, "dictionary_1 AS (SELECT * FROM dictionary)"]
    for k in range(1, n + 1):
        out.append(re.sub(r"\b(b_s\d|s\d|alts|best)\b", rf"\1_{k}", body).replace("FROM dictionary d", f"FROM dictionary_{k} d"))
        out.append(f"dictionary_{k + 1} AS MATERIALIZED (SELECT surface_id, entity, CAST(sum(cnt) AS BIGINT) AS cnt FROM s9_{k} WHERE entity IS NOT NULL GROUP BY ALL)")
    return ",\n".join(out)


query("fix_iterated", f"WITH {_sql_passes(3)} SELECT surface_id, entity, cnt FROM dictionary_4")(lambda s, d: L.iterate(_dictionary(s, d), _pass(s, d), 3)[0])
query("transition_compose", f"WITH {_sql_passes(2)} SELECT a.surface_id, a.old_entity, b.entity AS new_entity FROM s9_1 a LEFT JOIN s9_2 b ON b.surface_id = a.surface_id AND b.old_entity = a.entity")(lambda s, d: L.iterate(_dictionary(s, d), _pass(s, d), 2)[1])

# -- type search -------------------------------------------------------------------------------------------------------------

TYPES = "types AS MATERIALIZED (SELECT DISTINCT child AS entity, parent AS type FROM edges WHERE prop = 'P31')"


def _search(s, d) -> T.Search:
    """Over all targets of instance-of."""
    types = M.edges(s, d).where("prop = 'P31'").select(F.col("child").alias("entity"), F.col("parent").alias("type")).distinct()
    return T.Search(_mentions(s, d), _dictionary(s, d), types, penalty=0.0005)


GAIN = f"""WITH {M.EDGES}, {M.DICTIONARY}, {MENTIONS}, {TYPES},
prior AS (SELECT surface_id, first(entity ORDER BY cnt DESC, entity) AS b FROM dictionary GROUP BY surface_id),
rest AS MATERIALIZED (SELECT m.* FROM mentions m JOIN prior USING (surface_id) WHERE m.entity <> b),
marked AS MATERIALIZED (SELECT t.type, d.surface_id, d.entity, d.cnt, y.entity IS NOT NULL AS has FROM (SELECT DISTINCT type FROM types) t CROSS JOIN (SELECT * FROM dictionary WHERE surface_id IN (SELECT surface_id FROM rest)) d LEFT JOIN types y ON y.type = t.type AND y.entity = d.entity),
tops AS (SELECT type, surface_id, has, first(entity ORDER BY cnt DESC, entity) AS b FROM marked GROUP BY ALL),
gains AS (SELECT k.type, CAST(sum(r.n) AS BIGINT) AS improvement FROM rest r JOIN (SELECT type, surface_id AS sid, entity AS e, has FROM marked) k ON k.sid = r.surface_id AND k.e = r.entity JOIN tops ON tops.type = k.type AND tops.surface_id = k.sid AND tops.has = k.has WHERE tops.b = r.entity GROUP BY k.type),
totals AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (b = entity) AS BIGINT) AS greedy FROM mentions JOIN prior USING (surface_id))"""
query("greedy_remainder", GAIN + " SELECT surface_id, entity, n FROM rest")(lambda s, d: _search(s, d).rest.select("surface_id", "entity", "n"))
query("beam_round", GAIN + " SELECT t.type, coalesce(improvement, 0) AS improvement, round((greedy + coalesce(improvement, 0)) / total - 0.0005, 6) AS objective FROM (SELECT DISTINCT type FROM types) t LEFT JOIN gains USING (type) CROSS JOIN totals")(lambda s, d: _search(s, d).round([()]).select("type", "improvement", "objective"))
query("type_objective", GAIN + " SELECT round(greedy / total, 6) AS base, round(max((greedy + improvement) / total), 6) AS best_one FROM gains CROSS JOIN totals GROUP BY greedy, total")(lambda s, d: _search(s, d).best_single())
query("type_disambiguate", GAIN + " SELECT type, surface_id, has, b AS best FROM tops WHERE type IN (SELECT min(type) FROM types)")(lambda s, d: _search(s, d).one_type_tops())
query("greedy_search")(lambda s, d: _search(s, d).solve(1))
query("beam_search")(lambda s, d: _search(s, d).solve())
query("cross_entropy_search")(lambda s, d: _search(s, d).cross_entropy())
query("genetic_search")(lambda s, d: _search(s, d).genetic())
