"""Queries of text extraction, title resolution, vocabularies, sequences and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph import storage
from loomgraph.functions import text as X
from loomgraph.operators import metrics as E
from loomgraph.operators import sequences as S
from loomgraph.operators import tagger as G
from loomgraph.operators.links import resolve
from loomgraph.operators.ranks import rank_in_order, top_k
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


_P = f"WITH {M.PAGES}"
query("scan_articles_filter", _P + " SELECT article_id, title FROM pages WHERE title IS NOT NULL AND NOT (" + " OR ".join(f"starts_with(title, '{t}')" for t in X.HIDDEN_TITLES) + ")")(
    lambda s, d: M.pages(s, d).where("title is not null").where(~F.expr(" or ".join(f"startswith(title, '{t}')" for t in X.HIDDEN_TITLES))).select("article_id", "title")
)
query("doc_limit", _P + " SELECT article_id, title FROM pages ORDER BY article_id LIMIT 100")(lambda s, d: M.pages(s, d).select("article_id", "title").orderBy("article_id").limit(100))

_ANCHORS = M.PAGES + r""", raw AS (SELECT article_id, wiki, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS x FROM (SELECT article_id, wiki, regexp_extract_all(doc, '\[\[([^\]\[:]*)\]\]', 1) AS x FROM pages)),
anchor_parts AS (SELECT article_id, wiki, n, CASE WHEN contains(x, '|') THEN trim(split_part(trim(regexp_extract(x, '^(.*)\|', 1)), '#', 1)) ELSE trim(x) END AS target, CASE WHEN contains(x, '|') THEN trim(split_part(x, '|', -1)) ELSE trim(x) END AS anchor FROM raw),
anchors AS MATERIALIZED (SELECT article_id, wiki, CAST(row_number() OVER (PARTITION BY article_id ORDER BY n) - 1 AS INTEGER) AS pos, anchor, target FROM anchor_parts WHERE anchor <> '' AND target <> '')"""


def _anchors(s, d) -> DataFrame:
    return M.pages(s, d).select("article_id", "wiki", F.posexplode(X.anchors(F.col("doc"))).alias("pos", "a")).select("article_id", "wiki", "pos", "a.anchor", "a.target")


_A = f"WITH {_ANCHORS}"
query("extract_anchors", _A + " SELECT article_id, pos, anchor, target FROM anchors")(lambda s, d: _anchors(s, d).select("article_id", "pos", "anchor", "target"))
query("anchor_rows_with_self", _A + " SELECT article_id, title AS context, title AS anchor, title AS target FROM pages WHERE NOT contains(title, ':') UNION ALL SELECT article_id, title, anchor, target FROM anchors JOIN pages USING (article_id) WHERE NOT contains(title, ':')")(
    lambda s, d: (lambda p: p.select("article_id", F.col("title").alias("context"), F.col("title").alias("anchor"), F.col("title").alias("target")).unionByName(p.select("article_id", F.col("title").alias("context"), F.explode(X.anchors(F.col("doc"))).alias("a")).select("article_id", "context", "a.anchor", "a.target")))(M.pages(s, d).where("not contains(title, ':')"))
)
# the SQL of this module gives all fixed values itself, so that it is independent of the code it checks
_CATS = r"cats AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[\[((?:Category|Catégorie|Categorie|Categoría|Categoria|Kategorie|Kategoria|Категория|Kategori):[^\]\[]*)\]\]', 1)) AS x FROM documents), categories AS (SELECT doc_id, trim(CASE WHEN contains(x, '|') THEN split_part(regexp_extract(x, '^(.*)\|', 1), '#', 1) ELSE x END) AS category FROM cats)"


def _categories(s, d) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.explode(X.categories(F.col("text"))).alias("category"))


query("extract_categories", f"WITH {_CATS} SELECT * FROM categories")(_categories)
query("extract_redirects", r"SELECT doc_id, nullif(trim(split_part(split_part(regexp_extract(text, '(?i)(?:#REDIRECT|#weiterleitung|#REDIRECCIÓN|REDIRECIONAMENTO)\s*\[\[([^\]\[]*)\]\]', 1), '|', 1), '#', 1)), '') AS target FROM documents WHERE text IS NOT NULL")(
    lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", X.redirect(F.col("text")).alias("target"))
)
_TITLE = "upper(substr({t}, 1, 1)) || substr({t}, 2)"
_clean = lambda c: _TITLE.format(t=f"translate(split_part({c}, '#', 1), '_', ' ')")
query("clean_title", _A + f" SELECT DISTINCT target, {_clean('target')} AS title FROM anchors")(lambda s, d: _anchors(s, d).select("target", X.clean_title(F.col("target")).alias("title")).distinct())
_REDIRECTS = f"redirects AS MATERIALIZED (SELECT wiki, {_clean('anchor')} AS source, first(target ORDER BY article_id DESC, pos DESC) AS target FROM anchors WHERE anchor <> target AND octet_length(encode(anchor)) <= 256 GROUP BY ALL)"


def _redirects(s, d) -> DataFrame:
    """Surfaces that stand for another title, as redirects: of several the last writer wins."""
    a = _anchors(s, d).where("anchor <> target and octet_length(anchor) <= 256")
    return a.groupBy("wiki", X.clean_title(F.col("anchor")).alias("source")).agg(F.max_by("target", F.struct("article_id", "pos")).alias("target"))


query("redirect_load", _A + f", {_REDIRECTS} SELECT * FROM redirects")(_redirects)
_TITLES_ANCHORS = f"WITH {M.TITLES}, " + _ANCHORS.removeprefix(M.PAGES + ", ")


@query(
    "resolve_title",
    _TITLES_ANCHORS + f""", {_REDIRECTS} SELECT a.article_id, a.pos, coalesce(x.entity, y.entity, z.entity, -1) AS entity FROM anchors a LEFT JOIN titles x ON x.wiki = a.wiki AND x.title = a.target
LEFT JOIN titles y ON y.wiki = a.wiki AND y.title = {_clean('a.target')} LEFT JOIN redirects r ON r.wiki = a.wiki AND r.source = {_clean('a.target')} LEFT JOIN titles z ON z.wiki = a.wiki AND z.title = {_clean('r.target')}""",
)
def resolve_title(s, d) -> DataFrame:
    """Exact, else cleaned, else one redirect away, else -1. Only distinct targets are resolved, then joined back to the links."""
    links = storage.cut(_anchors(s, d), "anchors")
    got = resolve(links, storage.cut(M.titles(s, d), "titles"), _redirects(s, d))
    return links.join(got, ["wiki", "target"]).select("article_id", "pos", "entity")


_NAMES = "names AS MATERIALIZED (SELECT title, min(entity) AS entity FROM titles WHERE title IS NOT NULL GROUP BY title), asked AS (SELECT doc_id, category, page_qid, trim(split_part(category, ':', -1)) AS name FROM categories JOIN documents USING (doc_id)), ends AS MATERIALIZED (SELECT a.*, p.entity AS page, coalesce(x.entity, y.entity) AS entity FROM asked a LEFT JOIN names x ON x.title = name LEFT JOIN names y ON y.title = upper(substr(name, 1, 1)) || substr(name, 2) LEFT JOIN (SELECT DISTINCT qid, entity FROM entities) p ON p.qid = page_qid)"


def _category_ends(s, d) -> DataFrame:
    """(doc_id, category, name, page, entity): category links with the entities of both ends, null where unknown; a category is asked for again with a capital."""
    names = storage.cut(M.titles(s, d).where("title is not null").groupBy("title").agg(F.min("entity").alias("entity")), "names")
    docs = table(s, d, "documents").select("doc_id", F.col("page_qid").alias("qid"), F.explode(X.categories(F.col("text"))).alias("category")).withColumn("name", F.trim(F.substring_index("category", ":", -1)))
    named = lambda key, value: names.select(F.col("title").alias(key), F.col("entity").alias(value))
    docs = docs.withColumn("capital", F.concat(F.upper(F.substring("name", 1, 1)), F.col("name").substr(F.lit(2), F.length("name"))))
    out = docs.join(named("name", "x"), "name", "left").join(named("capital", "y"), "capital", "left").join(M.entities(s, d).withColumnRenamed("entity", "page"), "qid", "left")
    return out.select("doc_id", "category", "name", "page", F.coalesce("x", "y").alias("entity"))


query("category_join", f"WITH {M.TITLES}, {_CATS}, {_NAMES} SELECT doc_id, category, page, entity FROM ends WHERE page IS NOT NULL AND entity IS NOT NULL")(lambda s, d: _category_ends(s, d).where("page is not null and entity is not null").select("doc_id", "category", "page", "entity"))
query("category_join_missing", f"WITH {M.TITLES}, {_CATS}, {_NAMES} SELECT count(*) AS n_links, count(*) FILTER (name = '') AS malformed, count(*) FILTER (page IS NULL) AS missing_page, count(*) FILTER (name <> '' AND entity IS NULL) AS missing_category FROM ends")(
    lambda s, d: _category_ends(s, d).agg(F.count("*").alias("n_links"), F.count_if(F.col("name") == "").alias("malformed"), F.count_if(F.col("page").isNull()).alias("missing_page"), F.count_if((F.col("name") != "") & F.col("entity").isNull()).alias("missing_category"))
)
_ALT = r"""alts AS (SELECT title, 0 AS k, title AS alt FROM t UNION ALL SELECT title, 1, CASE WHEN title LIKE '%)' THEN rtrim(regexp_extract(title, '^(.*)\(', 1)) WHEN title LIKE '%ses' THEN regexp_replace(title, 'es$', '') || 'is'
    WHEN title LIKE '%ies' THEN regexp_replace(title, 'ies$', '') || 'y' WHEN title LIKE '%s' THEN regexp_replace(title, 's$', '') END FROM t)"""
query("name_alternates", f"WITH {M.TITLES}, t AS (SELECT DISTINCT title FROM titles), {_ALT} SELECT title, k, alt FROM alts WHERE alt IS NOT NULL")(
    lambda s, d: M.titles(s, d).select("title").distinct().select("title", F.posexplode(X.name_alternates(F.col("title"))).alias("k", "alt"))
)
query("fixed_points", f"WITH {M.TITLES}, {_CATS}, t AS (SELECT DISTINCT split_part(category, ':', -1) AS title FROM categories), {_ALT}, names AS (SELECT title AS alt, min(entity) AS entity FROM titles GROUP BY title) SELECT title, arg_min(entity, k) AS entity FROM alts JOIN names USING (alt) GROUP BY title")(
    lambda s, d: _categories(s, d).select(F.substring_index("category", ":", -1).alias("title")).distinct().select("title", F.posexplode(X.name_alternates(F.col("title"))).alias("k", "alt")).join(M.titles(s, d).groupBy(F.col("title").alias("alt")).agg(F.min("entity").alias("entity")), "alt").groupBy("title").agg(F.min_by("entity", "k").alias("entity"))
)
_SURFACE = r"""stop AS MATERIALIZED (SELECT string_split('a an in the of it from with this that they he she some where what since his her their le la les il elle ce ça ci ceux ceci cela celle se cet cette dans avec con sans pendant durant avant après puis el lo ese esto que qui quoi dont ou où si este esta cual eso ella depuis y à su de des du los las un une una uno para asi later into dentro dedans después desde al et por at for when why how whether if thus then and but on during while as within was is est au fait font va vont sur en pour del cuando cuan do does until sinon encore to by be which have not were has also its isbn pp. &amp; p. ces o', ' ') AS st),
trimmed AS (SELECT surface, regexp_replace(rtrim(surface), '^[()\[\]]+|[()\[\]]+$', '', 'g') AS t FROM (SELECT DISTINCT surface FROM surface_dictionary WHERE surface IS NOT NULL)),
worded AS (SELECT surface, t, list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(t, '^[lLdDjJtT]''', ''), '''s$', ''), '[ \t\n\r]+'), lambda x: x <> ''), lambda x: lower(x)) AS w FROM trimmed),
kept AS (SELECT surface, t, w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(st, w[i])) AS k FROM worded, stop),
cleaned AS MATERIALIZED (SELECT surface, CASE WHEN t = '' OR left(t, 1) IN ('''', ',', '-', '!', '.', '?', ':', '’') OR right(t, 1) IN ('''', ',', '-', '!', '.', '?', ':', '’') OR len(k) = 0 THEN '' ELSE array_to_string(w[k[1]:k[-1]], ' ') END AS clean FROM kept)"""


def _surfaces(s, d) -> DataFrame:
    return table(s, d, "surface_dictionary").where("surface is not null").select("surface").distinct().withColumn("clean", X.clean_surface(F.col("surface")))


query("clean_surface", f"WITH {_SURFACE} SELECT * FROM cleaned")(_surfaces)
query("clean_surfaces", f"WITH {_SURFACE} SELECT DISTINCT clean FROM cleaned WHERE clean <> ''")(lambda s, d: _surfaces(s, d).where("clean <> ''").select("clean").distinct())
query("clean_markup", _P + r""" SELECT article_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(doc, '\r\n?', chr(10), 'g'), '\t', ' ', 'g'), '(?s)<ref[^<>]*>.*?</ref>', ' ', 'g'), '(?s)\{\{[^{}]*\}\}', ' ', 'g'), '(?m)^==+ ?([^=\n]*?) ?==+[ \t]*$', chr(10) || chr(10) || '\1. ', 'g'), '(?m)^([*#]+) ?', '\1 ', 'g') AS plain FROM pages WHERE doc IS NOT NULL""")(
    lambda s, d: M.pages(s, d).where("doc is not null").select("article_id", X.clean_markup(F.col("doc")).alias("plain"))
)
_FRAG = M.PAGES + r""", pieces AS (SELECT article_id, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS x FROM (SELECT article_id, list_filter(string_split(regexp_replace(doc, '(\[\[[^\]\[]*\]\])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') AS x FROM pages WHERE doc IS NOT NULL)),
frags AS MATERIALIZED (SELECT article_id, CAST(n AS INTEGER) AS pos, CASE WHEN link THEN split_part(x[3:-3], '|', -1) ELSE x END AS text, CASE WHEN link THEN nullif(trim(split_part(x[3:-3], '|', 1)), '') END AS dest FROM (SELECT *, regexp_full_match(x, '(?s)\[\[[^\]\[]*\]\]') AS link FROM pieces))"""


def _fragments(s, d) -> DataFrame:
    return M.pages(s, d).select("article_id", F.explode(X.fragments(F.col("doc"))).alias("f")).select("article_id", "f.pos", "f.text", "f.dest")


query("link_fragments", f"WITH {_FRAG} SELECT * FROM frags")(_fragments)
_OFF = _FRAG + ", offs AS MATERIALIZED (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY article_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM frags)"
query("annotate_offsets", f"WITH {_OFF} SELECT article_id, pos, dest, start, start + length(text) AS \"end\" FROM offs")(lambda s, d: S.offsets(_fragments(s, d), "article_id", "pos", "text").select("article_id", "pos", "dest", "start", "end"))
_WORDS = ", plain AS (SELECT article_id, string_agg(text, '' ORDER BY pos) AS text FROM frags GROUP BY article_id), words AS MATERIALIZED (SELECT article_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS word FROM (SELECT article_id, string_split(text, ' ') AS x FROM plain)), placed AS MATERIALIZED (SELECT *, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY article_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM words)"


def _plain_words(s, d) -> DataFrame:
    frags = F.transform(X.fragments(F.col("doc")), lambda f: f["text"])
    return M.pages(s, d).where("doc <> ''").select("article_id", F.posexplode(F.split(F.array_join(frags, ""), " ")).alias("pos", "word")).where("word is not null")


@query("span_overlap_join", f"WITH {_OFF}{_WORDS} SELECT w.article_id, w.pos, (SELECT arg_min(o.dest, o.start) FROM offs o WHERE o.article_id = w.article_id AND o.dest IS NOT NULL AND w.start < o.start + length(o.text) AND w.start + length(w.word) > o.start) AS label FROM placed w")
def span_overlap_join(s, d) -> DataFrame:
    words = S.offsets(_plain_words(s, d).withColumn("padded", F.concat("word", F.lit(" "))), "article_id", "pos", "padded").withColumn("end", F.col("start") + F.length("word"))
    spans = S.offsets(_fragments(s, d), "article_id", "pos", "text").where("dest is not null").select("article_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("dest").alias("label"))
    return S.first_overlap(words.select("article_id", "pos", "start", "end"), spans, "article_id").select("article_id", "pos", "label")


_TOKENS = M.PAGES + r", tokens AS MATERIALIZED (SELECT article_id, wiki, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS token FROM (SELECT article_id, wiki, regexp_extract_all(doc, '[\p{L}\p{M}]+(?:''[\p{L}\p{M}]+)?|\p{Nd}+|[^\p{L}\p{M}\p{Nd}\p{Z}\t\n\v\f\r]') AS x FROM pages))"


def _tokens(s, d) -> DataFrame:
    return M.pages(s, d).select("article_id", "wiki", F.posexplode(X.tokens(F.col("doc"))).alias("pos", "token"))


_T = f"WITH {_TOKENS}"
query("tokenize_text", _T + " SELECT article_id, pos, token FROM tokens")(lambda s, d: _tokens(s, d).select("article_id", "pos", "token"))
_PARTS = r"""pieces AS (SELECT article_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS token FROM (SELECT article_id, regexp_extract_all(doc, '[\p{L}\p{M}]+(?:''[\p{L}\p{M}]+)?|\p{Nd}+|[\p{Z}\t\n\v\f\r]+|[^\p{L}\p{M}\p{Nd}\p{Z}\t\n\v\f\r]') AS x FROM pages)),
ended AS MATERIALIZED (SELECT *, CAST(sum(length(token)) OVER (PARTITION BY article_id ORDER BY pos) AS BIGINT) AS "end" FROM pieces),
old AS (SELECT article_id, word, CAST(sum(length(word) + 1) OVER (PARTITION BY article_id ORDER BY n) - 1 AS BIGINT) AS "end" FROM (SELECT article_id, generate_subscripts(x, 1) AS n, unnest(x) AS word FROM (SELECT article_id, string_split(doc, ' ') AS x FROM pages)))"""


def _pieces(s, d) -> DataFrame:
    """(article_id, pos, token, end): tokens and the blanks between them, so that their lengths add up to places in the text."""
    own = M.pages(s, d).select("article_id", F.posexplode(X.pieces(F.col("doc"))).alias("pos", "token"))
    return S.offsets(own, "article_id", "pos", "token").drop("start")


def _old_words(s, d) -> DataFrame:
    words = M.pages(s, d).select("article_id", F.posexplode(F.split("doc", " ")).alias("pos", "word")).withColumn("padded", F.concat("word", F.lit(" ")))
    return S.offsets(words, "article_id", "pos", "padded").select("article_id", "start", (F.col("start") + F.length("word")).alias("end"), X.uppercase(F.col("word")).alias("label"))


query("retokenize_labels", _P + ", " + _PARTS + r""" SELECT e.article_id, e.pos, e.token, regexp_matches(o.word, '^\p{Lu}') AS label FROM ended e LEFT JOIN old o ON o.article_id = e.article_id AND o."end" - length(o.word) < e."end" AND e."end" <= o."end" WHERE NOT regexp_full_match(e.token, '[\p{Z}\t\n\v\f\r]+')""")(
    lambda s, d: S.retokenize(_old_words(s, d), _pieces(s, d).where(~F.col("token").rlike(r"^[\p{Z}\s]+$")), "article_id").select("article_id", "pos", "token", "label")
)
_FEATURES = r"substr(token, greatest(length(token) - 2, 1)) AS suffix, substr(token, 1, 3) AS prefix, regexp_matches(token, '^\p{Nd}+$') AS digit, CAST(length(regexp_replace(token, '[^!-/:-@\[-`{-~]', '', 'g')) AS INTEGER) AS punctuation_count, regexp_matches(token, '^\p{Lu}') AS uppercase"
query("token_features", _T + f" SELECT DISTINCT token, {_FEATURES} FROM tokens")(lambda s, d: _tokens(s, d).select("token").distinct().select("token", *[c.alias(n) for n, c in X.token_features(F.col("token")).items()]))
_VOCAB = "vocab AS (SELECT token, count(*) AS n, min((article_id, pos)) AS f FROM tokens GROUP BY token), ranked AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS id FROM vocab)"


def _vocab(s, d) -> DataFrame:
    """(token, n, id): by falling count, ties by first occurrence; 0 is kept for unknown words. Ranks are made over distinct tokens."""
    v = _tokens(s, d).groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("article_id", "pos")).alias("f"))
    v = storage.cut(v.select("token", "n", F.col("f.article_id").alias("article_id"), F.col("f.pos").alias("pos")), "vocabulary")
    return rank_in_order(v, [], [-F.col("n")], "article_id", ["pos"], 64).select("token", "n", F.col("rank").cast("int").alias("id"))


query("vocab_build", _T + f", {_VOCAB} SELECT * FROM ranked")(_vocab)
query("vocab_topk", _T + f", {_VOCAB} SELECT * FROM ranked WHERE id <= 1000")(lambda s, d: _vocab(s, d).where("id <= 1000"))
_FEATURE_ROWS = ", long AS (SELECT 'word' AS feature, token AS value, article_id, pos FROM tokens UNION ALL SELECT 'suffix', substr(token, greatest(length(token) - 2, 1)), article_id, pos FROM tokens UNION ALL SELECT 'prefix', substr(token, 1, 3), article_id, pos FROM tokens)"


def _feature_vocabs(s, d, most: int) -> DataFrame:
    """(feature, id, value, n): by feature the most frequent values, ties by first occurrence; 0 stands for all unknown ones."""
    parts = (("word", F.col("token")), ("suffix", F.substring("token", -3, 3)), ("prefix", F.substring("token", 1, 3)))
    long = _tokens(s, d).select("article_id", "pos", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in parts])).alias("x"))
    v = long.groupBy("x.feature", "x.value").agg(F.count("*").alias("n"), F.min(F.struct("article_id", "pos")).alias("f"))
    few = top_k(v, ["feature"], [F.desc("n"), F.col("f"), F.col("value")], most, "value").select("feature", F.col("k_no").alias("id"), "value", "n")
    unknown = few.select("feature").distinct().select("feature", F.lit(0).alias("id"), F.lit("<UNK>").alias("value"), F.lit(0).cast("long").alias("n"))
    return few.unionByName(unknown)


query("feature_vocabs", _T + _FEATURE_ROWS + ", v AS (SELECT feature, value, count(*) AS n, min((article_id, pos)) AS f FROM long GROUP BY ALL), r AS (SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, f, value) AS INTEGER) AS id, value, n FROM v) SELECT * FROM r WHERE id <= 10000 UNION ALL SELECT DISTINCT feature, 0, '<UNK>', 0 FROM v")(lambda s, d: _feature_vocabs(s, d, 10_000))

# -- sequences -------------------------------------------------------------------------------------------------------------------

_LINED = M.PAGES + r", token_lines AS MATERIALIZED (SELECT article_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(list_transform(x, lambda t: CASE WHEN t[1] IN (chr(10), chr(13)) THEN '' ELSE t END)) AS token FROM (SELECT article_id, regexp_extract_all(doc, '[\p{L}\p{M}]+(?:''[\p{L}\p{M}]+)?|\p{Nd}+|[^\p{L}\p{M}\p{Nd}\p{Z}\t\n\v\f\r]|\r?\n[ \t]*\r?\n') AS x FROM pages)), lined AS (SELECT *, sum(CASE WHEN token = '' THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY pos) AS para FROM token_lines)"
_GROUPS = r", marked AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR pos - lag(pos) OVER w > 5 OR para <> lag(para) OVER w THEN 1 ELSE 0 END AS fresh FROM lined WHERE regexp_matches(token, '^\p{Lu}') WINDOW w AS (PARTITION BY article_id ORDER BY pos)), groups AS MATERIALIZED (SELECT article_id, pos, token, CAST(sum(fresh) OVER (PARTITION BY article_id ORDER BY pos) AS BIGINT) AS group_no FROM marked)"
_L = f"WITH {_LINED}"


def _token_lines(s, d) -> DataFrame:
    """(article_id, pos, token): tokens as lines of a file, with an empty one where a blank line stands in the text."""
    return M.pages(s, d).select("article_id", F.posexplode(X.token_lines(F.col("doc"))).alias("pos", "token"))


def _gap_groups(s, d) -> DataFrame:
    return S.gap_groups(_token_lines(s, d), "article_id", "pos", X.uppercase(F.col("token")), 5, F.col("token") == "")


def _context_windows(s, d) -> DataFrame:
    lines, blank = _token_lines(s, d), F.col("token") == ""
    groups = S.gap_groups(S.with_blanks(lines, "article_id", "pos", blank), "article_id", "pos", X.uppercase(F.col("token")), 5, blank)
    return S.context(lines, groups, "article_id", "pos", 5).select("article_id", "pos", "token", "group_no")


query("gap_groups", _L + _GROUPS + " SELECT * FROM groups")(_gap_groups)
query(
    "context_windows",
    _L + _GROUPS + ", bounds AS (SELECT article_id, group_no, min(pos) AS f, max(pos) AS l FROM groups GROUP BY ALL), cut AS (SELECT b.*, greatest(f - 5, 0, coalesce((SELECT max(pos) FROM token_lines t WHERE t.article_id = b.article_id AND token = '' AND pos < f), 0)) AS lo, "
    "least(l + 5, coalesce((SELECT min(pos) FROM token_lines t WHERE t.article_id = b.article_id AND token = '' AND pos > l), l + 5)) AS hi FROM bounds b) SELECT t.article_id, t.pos, token, group_no FROM token_lines t JOIN cut b ON b.article_id = t.article_id AND t.pos >= lo AND t.pos < hi",
)(_context_windows)
query("sliding_windows", _T + r" SELECT article_id, pos, array_to_string(w, ' ') AS win FROM (SELECT article_id, pos, token, list(token) OVER (PARTITION BY article_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS w, count(*) OVER (PARTITION BY article_id) AS n FROM tokens) WHERE pos >= 5 AND pos < n - 5 AND regexp_matches(token, '^\p{Lu}')")(
    lambda s, d: S.sliding(_tokens(s, d), "article_id", "pos", "token", 5, X.uppercase(F.col("token"))).select("article_id", "pos", F.array_join("window", " ").alias("win"))
)
_LINES = M.PAGES + ", lines AS MATERIALIZED (SELECT article_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS line FROM (SELECT article_id, string_split(doc, chr(10)) AS x FROM pages)), segs AS (SELECT *, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY pos) AS BIGINT) AS segment FROM lines)"


def _segments(s, d) -> DataFrame:
    lines = M.pages(s, d).select("article_id", F.posexplode(F.split("doc", "\n")).alias("pos", "line"))
    return S.segments(lines, "article_id", "pos", F.trim("line") == "")


query("segment_examples", f"WITH {_LINES} SELECT article_id, pos, segment FROM segs WHERE trim(line) <> ''")(lambda s, d: _segments(s, d).select("article_id", "pos", "segment"))
query("paragraph_group", f"WITH {_LINES} SELECT article_id, segment, count(*) AS n_lines, min(pos) AS first_line FROM segs WHERE trim(line) <> '' GROUP BY ALL")(lambda s, d: _segments(s, d).groupBy("article_id", "segment").agg(F.count("*").alias("n_lines"), F.min("pos").alias("first_line")))
query("count_examples", f"WITH {_LINES} SELECT count(*) AS n FROM (SELECT article_id, segment FROM segs WHERE trim(line) <> '' GROUP BY ALL HAVING bool_or(contains(line, '[[')))")(
    lambda s, d: _segments(s, d).groupBy("article_id", "segment").agg(F.bool_or(F.col("line").contains("[[")).alias("any")).where("any").agg(F.count("*").alias("n"))
)
query("train_dev_split", "SELECT line_no, CASE WHEN line_no >= 1000 AND line_no < 1500 THEN 'dev' ELSE 'train' END AS part FROM entity_dump")(lambda s, d: table(s, d, "entity_dump").select("line_no", F.when((F.col("line_no") >= 1000) & (F.col("line_no") < 1500), "dev").otherwise("train").alias("part")))
query("ordered_split", _P + " SELECT article_id, wiki, CASE WHEN row_number() OVER (PARTITION BY wiki ORDER BY article_id) <= floor(0.8 * count(*) OVER (PARTITION BY wiki)) THEN 'train' ELSE 'dev' END AS part FROM pages")(lambda s, d: S.ordered_split(M.pages(s, d).select("article_id", "wiki"), "wiki", "article_id", 0.8))
query("dataset_union", "SELECT 'articles' AS source, count(*) AS n FROM articles UNION ALL SELECT 'documents', count(*) FROM documents")(
    lambda s, d: table(s, d, "articles").select(F.lit("articles").alias("source")).unionByName(table(s, d, "documents").select(F.lit("documents").alias("source"))).groupBy("source").agg(F.count("*").alias("n"))
)
query("pad_sequences", _T + ", s AS (SELECT article_id, pos // 10 AS chunk, list(token ORDER BY pos) AS x FROM tokens GROUP BY ALL) SELECT article_id, chunk, array_to_string(x || list_resize(CAST([] AS VARCHAR[]), 10 - len(x), '_'), ' ') AS padded FROM s")(
    lambda s, d: _tokens(s, d).groupBy("article_id", F.expr("cast(pos div 10 as int)").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x")).select("article_id", "chunk", F.array_join(S.pad(F.transform("x", lambda t: t["token"]), 10, F.lit("_")), " ").alias("padded"))
)
query("label_mask", _T + r" SELECT article_id, pos, regexp_matches(token, '^\p{Lu}') AS mask FROM tokens")(lambda s, d: _tokens(s, d).select("article_id", "pos", X.uppercase(F.col("token")).alias("mask")))
query("label_mask_sequence", _T + r" SELECT article_id, pos, first_value(regexp_matches(token, '^\p{Lu}')) OVER (PARTITION BY article_id ORDER BY pos) AS mask FROM tokens")(lambda s, d: S.sequence_mask(_tokens(s, d), "article_id", "pos", X.uppercase(F.col("token"))).select("article_id", "pos", "mask"))
query("batch_packing")(lambda s, d: S.pack_batches(_tokens(s, d).groupBy("article_id").agg(F.count("*").alias("n")), "article_id", "n", 200, 8))

# -- metrics ---------------------------------------------------------------------------------------------------------------------

_SCORED = "scored AS MATERIALIZED (SELECT l.annotator, l.doc_id, l.verdict AS y, d.n_chars % 97 AS score FROM moderation_labels l JOIN documents d USING (doc_id) WHERE l.verdict IS NOT NULL AND d.n_chars IS NOT NULL)"


def _scored(s, d) -> DataFrame:
    """Verdicts beside a score with many ties; what is measured doesn't matter here."""
    return table(s, d, "moderation_labels").where("verdict is not null").join(table(s, d, "documents").where("n_chars is not null").select("doc_id", "n_chars"), "doc_id").select("annotator", "doc_id", F.col("verdict").alias("y"), (F.col("n_chars") % 97).alias("score"))


_AUC = "pairs AS (SELECT a.annotator, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS won, count(*) AS n FROM scored a JOIN scored b ON a.annotator = b.annotator AND a.y = 1 AND b.y = 0 GROUP BY a.annotator), aucs AS MATERIALIZED (SELECT annotator, CAST(round(won / n, 6) AS DOUBLE) AS auc FROM pairs)"
query("auc_score", f"WITH {_SCORED}, {_AUC} SELECT * FROM aucs")(lambda s, d: E.auc(_scored(s, d), "annotator"))
query("average_precision", f"WITH {_SCORED}, lv AS (SELECT annotator, score, sum(y) AS p, count(*) AS c FROM scored GROUP BY ALL), cum AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS allc FROM lv WINDOW w AS (PARTITION BY annotator ORDER BY score DESC)) SELECT annotator, round(sum(CAST(p AS DOUBLE) * tp / allc) / sum(p), 6) AS average_precision FROM cum GROUP BY annotator HAVING sum(p) > 0")(lambda s, d: E.average_precision(_scored(s, d), "annotator"))
_RUNS = "runs AS MATERIALIZED (SELECT l.annotator, coalesce(d.source, '-') AS relation, l.verdict AS y, d.n_chars % 97 AS score FROM moderation_labels l JOIN documents d USING (doc_id) WHERE l.verdict IS NOT NULL AND d.n_chars IS NOT NULL), run_auc AS (SELECT a.annotator, a.relation, CAST(round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS DOUBLE) AS auc FROM runs a JOIN runs b ON a.annotator = b.annotator AND a.relation = b.relation AND a.y = 1 AND b.y = 0 GROUP BY a.annotator, a.relation)"


def _run_aucs(s, d) -> DataFrame:
    """(relation, auc): of each run (here an annotator) and relation (here a source)."""
    rows = _scored(s, d).join(table(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("relation")), "doc_id").withColumn("run", F.concat_ws("\t", "annotator", "relation"))
    return E.auc(rows, "run").select(F.substring_index("run", "\t", -1).alias("relation"), "auc")


query("auc_average", f"WITH {_RUNS} SELECT relation, count(*) AS n, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std FROM run_auc GROUP BY relation HAVING avg(auc) > 0.5")(lambda s, d: E.auc_average(_run_aucs(s, d), "relation", 0.5))
query("auc_histogram", f"WITH {_SCORED}, {_AUC} SELECT CAST(least(floor(auc * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM aucs GROUP BY bin")(lambda s, d: E.auc(_scored(s, d), "annotator").groupBy(F.least(F.floor(F.col("auc") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n")))
query("binary_accuracy", f"WITH {_SCORED} SELECT annotator, count(*) AS n, count(*) FILTER ((score >= 48) = (y = 1)) AS correct, count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS negative FROM scored GROUP BY annotator")(
    lambda s, d: _scored(s, d).groupBy("annotator").agg(F.count("*").alias("n"), F.count_if((F.col("score") >= 48) == (F.col("y") == 1)).alias("correct"), F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative"))
)
_CONF = "guess AS (SELECT *, CAST(score >= 48 AS INTEGER) AS g FROM scored), conf AS MATERIALIZED (SELECT c.class, count(*) FILTER (y = class AND g = class) AS tp, count(*) FILTER (y <> class AND g = class) AS fp, count(*) FILTER (y = class AND g <> class) AS fn FROM guess CROSS JOIN (SELECT unnest([0, 1]) AS class) c GROUP BY c.class)"
_guess = lambda s, d: _scored(s, d).withColumn("g", (F.col("score") >= 48).cast("int"))
query("confusion_counts", f"WITH {_SCORED}, {_CONF} SELECT * FROM conf")(lambda s, d: E.confusion(_guess(s, d), "y", "g"))
query("weighted_f1", f"WITH {_SCORED}, {_CONF}, pr AS (SELECT tp / greatest(tp + fp, 1e-6) AS p, tp / greatest(tp + fn, 1e-6) AS r, tp + fn AS s FROM conf), f AS (SELECT *, 2 * p * r / greatest(p + r, 1e-6) AS f FROM pr) SELECT round(100 * sum(p * s) / sum(s), 6) AS precision, round(100 * sum(r * s) / sum(s), 6) AS recall, round(100 * sum(f * s) / sum(s), 6) AS f1 FROM f")(lambda s, d: E.weighted_f1(E.confusion(_guess(s, d), "y", "g")))
query("token_sentence_accuracy", f"WITH {_SCORED}, {_CONF}, per AS (SELECT doc_id, count(*) AS n, count(*) FILTER (y = g) AS k FROM guess GROUP BY doc_id) SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(k) AS BIGINT) AS token_correct, count(*) AS sentences, count(*) FILTER (n = k) AS sentence_correct FROM per")(lambda s, d: E.sequence_accuracy(_guess(s, d), "doc_id", "y", "g"))
query("metric_merge", f"WITH {_SCORED} SELECT annotator AS metric, CAST(sum(y) AS BIGINT) AS value FROM scored GROUP BY annotator UNION ALL SELECT 'all', CAST(sum(y) AS BIGINT) FROM scored")(lambda s, d: (lambda x: x.groupBy(F.col("annotator").alias("metric")).agg(F.sum("y").alias("value")).unionByName(x.agg(F.lit("all").alias("metric"), F.sum("y").alias("value"))))(_scored(s, d)))
_LOGITS = "logits AS (SELECT doc_id, [CAST(n_chars % 7 AS DOUBLE), CAST(doc_id % 5 AS DOUBLE), CAST(n_chars % 3 AS DOUBLE)] AS z FROM documents WHERE n_chars IS NOT NULL), probs AS (SELECT doc_id, z, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p FROM logits)"
_logits = lambda s, d: table(s, d, "documents").where("n_chars is not null").select("doc_id", F.array((F.col("n_chars") % 7).cast("double"), (F.col("doc_id") % 5).cast("double"), (F.col("n_chars") % 3).cast("double")).alias("z"))
query("softmax_argmax", f"WITH {_LOGITS} SELECT doc_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS tag, round(list_max(p), 6) AS probability FROM probs")(
    lambda s, d: _logits(s, d).select("doc_id", E.softmax(F.col("z")).alias("p")).select("doc_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("tag"), F.round(F.array_max("p"), 6).alias("probability"))
)
query("topk_tags", f"WITH {_LOGITS}, u AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS place, unnest(p) AS score FROM probs) SELECT doc_id, place, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) <= 2")(
    lambda s, d: _logits(s, d).select("doc_id", F.explode(E.top_k(E.softmax(F.col("z")), 2)).alias("t")).select("doc_id", "t.place", F.round("t.score", 6).alias("score"))
)
query("prob_threshold", f"WITH {_LOGITS}, u AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS place, unnest(p) AS score FROM probs) SELECT doc_id, place FROM u WHERE score > 0.1")(
    lambda s, d: _logits(s, d).select("doc_id", F.posexplode(E.softmax(F.col("z"))).alias("place", "score")).where("score > 0.1").select("doc_id", "place")
)


def _token_scores(s, d) -> DataFrame:
    """(article_id, pos, z): three scores of each token, made from its form; what they say doesn't matter here."""
    n = F.length("token")
    return _tokens(s, d).select("article_id", "pos", F.array((n % 7).cast("double"), (n % 5).cast("double"), X.uppercase(F.col("token")).cast("double")).alias("z"))


query("viterbi_decode")(lambda s, d: E.viterbi_decode(_token_scores(s, d), "article_id", "pos", "z", np.eye(3) * 0.5))


def _tagged(s, d) -> DataFrame:
    """The three most probable kinds of each token by its ending, of a model counted over the same tokens' capitals, digits and marks."""
    t = _tokens(s, d)
    kind = F.when(X.uppercase(F.col("token")), "capital").when(F.col("token").rlike(r"^\p{Nd}"), "number").when(F.col("token").rlike(r"^\p{L}"), "word").otherwise("mark")
    model = G.fit_endings(t.withColumn("kind", kind), "token", "kind")
    sentences = M.pages(s, d).select("article_id", X.tokens(F.col("doc")).alias("tokens"))
    return G.tag_sentences(sentences, "article_id", "tokens", model, 3, 0.1).select("article_id", "pos", "token", F.explode("tags").alias("t")).select("article_id", "pos", "token", "t.tag", F.round("t.probability", 6).alias("probability"))


query("tag_sentences")(_tagged)
