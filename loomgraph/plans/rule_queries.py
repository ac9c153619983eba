"""Queries of rule classifiers, truth tables, sequences read from files, label joins, and draws by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.functions import text as X
from loomgraph.operators import classify as C
from loomgraph.operators import graph as G
from loomgraph.operators import learnability as N
from loomgraph.operators import sequences as S
from loomgraph.operators.graph import Rule, TypeGraph
from loomgraph.plans import graph_queries as GQ
from loomgraph.plans import mention_queries as MQ
from loomgraph.plans import model as M
from loomgraph.plans import text_queries as TQ
from loomgraph.plans.tables import table
from loomgraph.sinks import writers
from loomgraph.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# -- classifications from rules ------------------------------------------------------------------------------------------


def _core(s, d, *kinds: str) -> dict[str, tuple[int, ...]]:
    """By kind the shared reference items of that kind: a fixed list of 300."""
    rows = table(s, d, "core_entities").where(F.col("kind_name").isin(list(kinds))).select(F.col("entity").cast("long"), "kind_name").collect()
    return {k: tuple(sorted(r["entity"] for r in rows if r["kind_name"] == k)) for k in kinds}


def _exported(s, d, sets: list[Rule], names: dict[int, str], classes: list[C.ClassRule]) -> DataFrame:
    return C.export(MQ._all(s, d), C.by_rules(TypeGraph(MQ._edges(s, d)), sets, names, classes)).select("entity", "label")


_WALK = "walk AS (SELECT kind, CAST(entity AS BIGINT) AS entity{d0} FROM (SELECT kind_name AS kind, entity FROM core_entities WHERE kind_name IN ({kinds})) UNION SELECT w.kind, e.child{d1} FROM walk w JOIN edges e ON e.parent = w.entity AND e.prop IN ({props}){more})"
_LABEL = "SELECT entity, coalesce(label, 'other') AS label FROM (SELECT DISTINCT entity FROM entities) LEFT JOIN (SELECT entity, max(label) AS label FROM found GROUP BY entity) USING (entity)"


@query(
    "location_classifier",
    f"WITH RECURSIVE {M.EDGES}, {_WALK.format(d0='', d1='', kinds=chr(39) + 'country' + chr(39) + ', ' + chr(39) + 'city' + chr(39) + ', ' + chr(39) + 'river' + chr(39) + ', ' + chr(39) + 'language' + chr(39), props=', '.join(chr(39) + p + chr(39) for p in ('P17', 'P131', 'P361', 'P31', 'P279')), more='')}, "
    "found AS (SELECT DISTINCT entity, kind AS label FROM walk w WHERE kind IN ('river', 'language') AND entity NOT IN (SELECT entity FROM walk WHERE kind IN ('country', 'city')) "
    "UNION SELECT entity, 'city' FROM walk WHERE kind = 'city' AND entity NOT IN (SELECT entity FROM walk WHERE kind = 'country') UNION SELECT entity, 'country' FROM walk WHERE kind = 'country') " + _LABEL,
)
def location_classifier(s, d) -> DataFrame:
    """Where something lies, over five relations: a country excludes a city, and both exclude what rivers and languages reach."""
    kinds = ("country", "city", "river", "language")
    core = _core(s, d, *kinds)
    sets = [Rule(k, ("P17", "P131", "P361", "P31", "P279"), core[n]) for k, n in enumerate(kinds)]
    classes = [C.ClassRule("country", ("in country",)), C.ClassRule("city", ("in city",), ("country",)), C.ClassRule("river", ("in river",), ("country", "in city")), C.ClassRule("language", ("in language",), ("country", "in city"))]
    return _exported(s, d, sets, {k: f"in {n}" for k, n in enumerate(kinds)}, classes)


_TYPES = ("human", "taxon rank", "language", "film", "award", "river", "sport", "occupation", "city", "country")
_FOUND = "\nUNION ALL ".join(
    f"SELECT DISTINCT entity, '{t}' AS label FROM walk WHERE kind = '{t}'" + (" AND entity NOT IN (SELECT entity FROM walk WHERE kind IN (" + ", ".join(f"'{x}'" for x in _TYPES[:k]) + "))" if k else "") for k, t in enumerate(_TYPES)
)


@query("type_classifier_rules", f"WITH RECURSIVE {M.EDGES}, {_WALK.format(d0='', d1='', kinds=', '.join(chr(39) + t + chr(39) for t in _TYPES), props=chr(39) + 'P31' + chr(39) + ', ' + chr(39) + 'P279' + chr(39), more='')}, found AS ({_FOUND}) {_LABEL}")
def type_classifier_rules(s, d) -> DataFrame:
    """What something is: by kind the closure over instance and subclass, each class without all that stand before it."""
    core = _core(s, d, *_TYPES)
    sets = [Rule(k, ("P31", "P279"), core[t]) for k, t in enumerate(_TYPES)]
    classes = [C.ClassRule(t, (f"is {t}",), tuple(f"is {x}" for x in _TYPES[:k])) for k, t in enumerate(_TYPES)]
    return _exported(s, d, sets, {k: f"is {t}" for k, t in enumerate(_TYPES)}, classes)


@query(
    "country_classifier_rules",
    f"WITH RECURSIVE {M.EDGES}, walk AS (SELECT CAST(entity AS BIGINT) AS root, CAST(entity AS BIGINT) AS entity, 0 AS d FROM core_entities WHERE kind_name = 'country' UNION "
    "SELECT w.root, e.child, w.d + 1 FROM walk w JOIN edges e ON e.parent = w.entity AND e.prop IN ('P17', 'P131') WHERE w.d < 3), "
    "places AS (SELECT DISTINCT child AS entity FROM edges WHERE prop = 'P131'), "
    "found AS (SELECT entity, 'C' || lpad(CAST(root AS VARCHAR), 4, '0') AS label FROM walk WHERE d > 0 UNION SELECT entity, 'B unlocated' FROM places WHERE entity NOT IN (SELECT entity FROM walk)) " + _LABEL,
)
def country_classifier_rules(s, d) -> DataFrame:
    """The country that something lies in, by at most three steps from each of the countries; places that none reaches are unlocated."""
    countries = _core(s, d, "country")["country"]
    edges = MQ._edges(s, d)
    sets = [Rule(k, ("P17", "P131"), (c,), 3) for k, c in enumerate(countries)]
    graph = TypeGraph(edges)
    within = storage.cut(graph.closures(sets), "countries")
    label = F.element_at(F.array(*[F.lit(f"C{c:04d}") for c in countries]), F.col("rule_id") + 1)
    root = F.element_at(F.array(*[F.lit(int(c)) for c in countries]), F.col("rule_id") + 1)
    # a root is its own country only if another step leads back to it, as it does in the walk
    back = edges.where(F.col("prop").isin("P17", "P131")).select(F.col("child").alias("entity"), F.col("parent"))
    reached = within.where(F.col("entity") != root).select("entity", label.alias("label"))
    near = storage.cut(graph.closures([Rule(r.rule_id, r.relations, r.seeds, 2) for r in sets]), "near")  # parents of what three steps reach
    own = within.where(F.col("entity") == root).join(back, "entity").join(near.select("rule_id", F.col("entity").alias("parent")), ["rule_id", "parent"], "left_semi").select("entity", label.alias("label"))
    loose = C.none_of(MQ._located(edges), within).select("entity", F.lit("B unlocated").alias("label"))
    best = reached.unionByName(own).unionByName(loose).groupBy("entity").agg(F.max("label").alias("label"))
    return MQ._all(s, d).join(best, "entity", "left").select("entity", F.coalesce("label", F.lit("other")).alias("label"))


@query("truth_tables", GQ.SQL["closure_batched"].removesuffix("SELECT DISTINCT rule_id, entity FROM walk").rstrip() + f""", {M.DICTIONARY}, corpus AS MATERIALIZED (SELECT DISTINCT d.entity FROM dictionary d JOIN entities USING (entity)),
own AS (SELECT DISTINCT rule_id, entity FROM walk WHERE entity IN (SELECT entity FROM corpus)) SELECT rule_id, entity FROM own WHERE rule_id IN (SELECT rule_id FROM own GROUP BY rule_id HAVING count(*) < (SELECT count(*) FROM corpus))""")
def truth_tables(s, d) -> DataFrame:
    """The closures of 40 rules over the entities that the dictionary has; rules that hold all or none of them tell nothing and go."""
    corpus = storage.cut(M.dictionary(s, d).select("entity").distinct().join(MQ._all(s, d), "entity", "left_semi"), "corpus")
    return C.truth_table(storage.cut(GQ._graph(s, d).closures(GQ.RULES), "rules"), corpus)


# -- lists and negatives --------------------------------------------------------------------------------------------------

query("remove_negatives", f"WITH {M.EDGES}, l AS (SELECT l.prop, a.entity AS child, coalesce(b.entity, -1) AS parent, l.claim_no AS pos FROM leaves l JOIN entities a ON a.qid = l.qid LEFT JOIN entities b ON b.qid = l.leaf_text WHERE leaf_kind = 'main' AND leaf_text LIKE 'Q%') SELECT prop, child, parent, CAST(row_number() OVER (PARTITION BY prop, child ORDER BY pos) - 1 AS INTEGER) AS pos FROM l WHERE parent >= 0")(
    lambda s, d: G.without_deleted(GQ.resolve_edges_left(s, d))
)
query("lists_to_edges", f"WITH {M._RECORDS} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY claim_no) - 1 AS INTEGER) AS pos, leaf_text AS value FROM leaves WHERE leaf_kind = 'main' AND prop = 'P31'")(
    lambda s, d: G.from_lists(M.leaves(s, d).where("leaf_kind = 'main' and prop = 'P31'").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("claim_no", "leaf_text"))).alias("x")).select("qid", F.transform("x", lambda t: t["leaf_text"]).alias("x")), "qid", "x")
)

# -- sequences ------------------------------------------------------------------------------------------------------------


def _labelled(s, d) -> DataFrame:
    """(article_id, pos, token, label, seq): tokens in sequences of 50, capitalised ones labelled; no token that would look like a comment."""
    t = TQ._tokens(s, d).where("not startswith(token, '#')")
    return t.select("article_id", "pos", "token", F.when(X.uppercase(F.col("token")), "U").alias("label"), F.concat_ws("/", F.col("article_id"), F.expr("pos div 50")).alias("seq"))


@query("seq_read_tsv", TQ._T + r", own AS (SELECT article_id, pos // 50 AS c, pos, token, CASE WHEN regexp_matches(token, '^\p{Lu}') THEN 'U' ELSE '-' END AS label FROM tokens WHERE NOT starts_with(token, '#')), seqs AS (SELECT string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(label, ' ' ORDER BY pos) AS labels FROM own GROUP BY article_id, c) SELECT tokens, labels, count(*) AS n FROM seqs WHERE contains(labels, 'U') GROUP BY ALL")
def seq_read_tsv(s, d) -> DataFrame:
    """Sequences written as tab-separated lines and read back: those without any label are dropped."""
    path = storage.new_path(s, "tsv")
    writers.labelled_tokens(_labelled(s, d), path, "seq", "pos", ["token", "label"])
    rows = readers.labelled_sequences(s, path)
    got = rows.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "token", F.coalesce("label", F.lit("-")).alias("label")))).alias("x"))
    return got.select(F.array_join(F.transform("x", lambda t: t["token"]), " ").alias("tokens"), F.array_join(F.transform("x", lambda t: t["label"]), " ").alias("labels")).groupBy("tokens", "labels").agg(F.count("*").alias("n"))


@query("seq_label_join", f"WITH {M.EDGES}, {MQ.KINDS}, {M.PAGES} SELECT article_id, p.qid, x.class_id AS kind_class, CASE WHEN p.qid IS NULL THEN NULL WHEN l.entity IS NULL THEN 1 ELSE 0 END AS place_class FROM (SELECT article_id, article_qid AS qid FROM pages WHERE article_qid IS NULL OR article_qid IN (SELECT qid FROM entities)) p LEFT JOIN (SELECT DISTINCT qid, entity FROM entities) e ON e.qid = p.qid LEFT JOIN exported x ON x.entity = e.entity LEFT JOIN located l ON l.entity = e.entity")
def seq_label_join(s, d) -> DataFrame:
    """Pages' ids as labels, with their class in two classifications; pages without an id have none."""
    e = MQ._edges(s, d)
    ids = M.entities(s, d)
    labels = M.pages(s, d).select("article_id", F.col("article_qid").alias("qid"))
    known = labels.where("qid is null").unionByName(labels.join(ids.select("qid"), "qid", "left_semi").select("article_id", "qid"))
    place = C.export(MQ._all(s, d), {"0 located": MQ._located(e)})
    return C.label_classes(known, ids, {"kind_class": MQ._kind_classes(s, d, e), "place_class": place}).select("article_id", "qid", "kind_class", "place_class")


@query("sqldump_lookup", "SELECT CAST(entity AS BIGINT) AS page_id, qid FROM entity_ids WHERE regexp_full_match(qid, 'Q[0-9]+')")
def sqldump_lookup(s, d) -> DataFrame:
    """The ids written as the tuples of a SQL dump, beside tuples of other properties, and read back."""
    ids = table(s, d, "entity_ids")
    tuples = F.concat(F.lit("("), F.col("entity").cast("string"), F.lit(",'wikibase_item','"), F.col("qid"), F.lit("',NULL),("), F.col("entity").cast("string"), F.lit(",'displaytitle','Q1',NULL)"))
    lines = ids.groupBy(F.expr("entity div 100").alias("k")).agg(F.concat(F.lit("INSERT INTO `page_props` VALUES "), F.array_join(F.collect_list(tuples), ","), F.lit(";")).alias("value"))
    return readers.page_entities(lines)


@query("dataset_mix", "SELECT source, id, round(CAST('0x' || substr(md5(id || '|' || source || '|3'), 1, 8) AS BIGINT) / 4294967296.0, 9) AS draw FROM (SELECT DISTINCT 'articles' AS source, article_id AS id FROM articles UNION ALL SELECT 'documents', doc_id FROM documents)")
def dataset_mix(s, d) -> DataFrame:
    parts = {"articles": M.pages(s, d).select(F.col("article_id").alias("id")), "documents": table(s, d, "documents").select(F.col("doc_id").alias("id"))}
    return S.mix(parts, "id", 3).select("source", "id", F.round("draw", 9).alias("draw"))


query("random_order", "WITH c AS (SELECT doc_id, doc_id // 100 AS c, CAST('0x' || substr(md5(doc_id || '|3'), 1, 8) AS BIGINT) AS h FROM documents) SELECT doc_id, round(CAST('0x' || substr(md5(c || '|chunk|3'), 1, 8) AS BIGINT) / 4294967296.0, 9) AS chunk_order, CAST(row_number() OVER (PARTITION BY c ORDER BY h, doc_id) AS INTEGER) AS place FROM c")(
    lambda s, d: S.shuffled(table(s, d, "documents").select("doc_id"), "doc_id", 100, 3).select("doc_id", F.round("chunk_order", 9).alias("chunk_order"), "place")
)
_DRAW = lambda k: f"CAST('0x' || substr(md5(article_id || '|' || pos || '|{k}|5'), 1, 8) AS BIGINT) / 4294967296.0"
query(
    "token_dropout",
    TQ._T + rf", a AS (SELECT *, CASE WHEN regexp_matches(token, '^\p{{Lu}}') AND {_DRAW('case')} < 0.3 THEN lower(token) ELSE token END AS t FROM tokens), b AS (SELECT *, CASE WHEN t LIKE '%s' AND {_DRAW('plural')} < 0.4 THEN left(t, -1) ELSE t END AS u FROM a) SELECT article_id, pos, CASE WHEN {_DRAW('word')} < 0.1 THEN '' ELSE u END AS dropped FROM b",
)(lambda s, d: S.dropout(TQ._tokens(s, d), "article_id", "pos", "token", 0.3, 0.4, 0.1, 5).select("article_id", "pos", "dropped"))
query(
    "character_codes",
    TQ._T + ", w AS (SELECT DISTINCT token FROM tokens), c AS (SELECT token, [255] || list_transform(range(1, octet_length(encode(token)) + 1), lambda i: CAST('0x' || substr(hex(encode(token)), 2 * i - 1, 2) AS INTEGER)) || [256] AS x FROM w) SELECT token, array_to_string(CASE WHEN len(x) < 12 THEN list_resize(x, 12, -1) ELSE x END, ' ') AS codes FROM c",
)(lambda s, d: TQ._tokens(s, d).select("token").distinct().select("token", F.array_join(F.transform(X.byte_codes(F.col("token"), 12), lambda x: x.cast("string")), " ").alias("codes")))


@query("tag_paragraphs", f"WITH {TQ._OFF}{TQ._WORDS}, tagged AS (SELECT w.article_id, w.pos, w.word, (SELECT arg_min(o.dest, o.start) FROM offs o WHERE o.article_id = w.article_id AND o.dest IS NOT NULL AND w.start < o.start + length(o.text) AND w.start + length(w.word) > o.start) AS label FROM placed w) SELECT article_id, pos, label, CAST(coalesce(sum(CASE WHEN contains(word, chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS paragraph FROM tagged")
def tag_paragraphs(s, d) -> DataFrame:
    """Words with the first link that overlaps them and the number of their paragraph: one ends with a word that holds a line end."""
    tagged = TQ.span_overlap_join(s, d).join(TQ._plain_words(s, d), ["article_id", "pos"])
    return S.paragraphs(tagged, "article_id", "pos", F.col("word").contains("\n")).select("article_id", "pos", "label", "paragraph")


# -- search and learnability -------------------------------------------------------------------------------------------------

query("best_types", MQ.GAIN + ", scored AS (SELECT t.type, coalesce(improvement, 0) AS improvement, round((greedy + coalesce(improvement, 0)) / total - 0.0005, 6) AS objective FROM (SELECT DISTINCT type FROM types) t LEFT JOIN gains USING (type) CROSS JOIN totals) SELECT * FROM scored ORDER BY objective DESC, type LIMIT 20")(lambda s, d: MQ._search(s, d).best_types(20))
query("subset_search")(lambda s, d: MQ._search(s, d).solve(2, subset=20))


@query("learnability_report")
def learnability_report(s, d) -> DataFrame:
    """How well a linear model over hashed words tells the kinds of pages apart, on the last fifth of the pages."""
    kinds = MQ._kind_classes(s, d, MQ._edges(s, d))
    pages = M.pages(s, d).where("article_qid is not null and doc <> ''").join(M.entities(s, d).withColumnRenamed("qid", "article_qid"), "article_qid")
    rows = pages.join(kinds.select("entity", "label"), "entity").select("article_id", X.tokens(F.col("doc")).alias("tokens"), "label")
    return N.report(storage.cut(rows, "examples"), "article_id", "tokens", "label", ["city", "human", "film", "taxon rank"])
