"""Queries from links in pages to counted surfaces and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.functions import text as X
from loomgraph.operators import links as K
from loomgraph.operators import repair as L
from loomgraph.plans import mention_queries as MQ
from loomgraph.plans import model as M
from loomgraph.plans import text_queries as TQ

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _lines(s, d) -> DataFrame:
    """(wiki, context, anchor, target): the links of pages whose title has no colon, and a line of its own for each such page."""
    p = M.pages(s, d).where("not contains(title, ':')")
    own = p.select("wiki", F.col("title").alias("context"), F.col("title").alias("anchor"), F.col("title").alias("target"))
    return own.unionByName(p.select("wiki", F.col("title").alias("context"), F.explode(X.anchors(F.col("doc"))).alias("a")).select("wiki", "context", "a.anchor", "a.target"))


def _resolved(s, d) -> DataFrame:
    return storage.cut(K.resolved_lines(_lines(s, d), storage.cut(M.titles(s, d), "titles"), TQ._redirects(s, d)), "resolved")


_JOINS = f"""LEFT JOIN titles x ON x.wiki = q.wiki AND x.title = q.t LEFT JOIN titles y ON y.wiki = q.wiki AND y.title = {TQ._clean('q.t')}
    LEFT JOIN redirects r ON r.wiki = q.wiki AND r.source = {TQ._clean('q.t')} LEFT JOIN titles z ON z.wiki = q.wiki AND z.title = {TQ._clean('r.target')}"""
_RESOLVED = f"""{M.TITLES}, {TQ._ANCHORS.removeprefix(M.PAGES + ', ')}, {TQ._REDIRECTS},
link_lines AS (SELECT wiki, title AS context, title AS anchor, title AS target FROM pages WHERE NOT contains(title, ':') UNION ALL
    SELECT p.wiki, p.title, anchor, target FROM anchors JOIN pages p USING (article_id) WHERE NOT contains(title, ':')),
short AS MATERIALIZED (SELECT *, anchor AS surface FROM link_lines WHERE octet_length(encode(context)) <= 256 AND octet_length(encode(anchor)) + octet_length(encode(target)) + 2 <= 256),
asked AS (SELECT wiki, target AS t FROM short UNION SELECT wiki, context FROM short),
known AS MATERIALIZED (SELECT q.wiki, q.t, coalesce(x.entity, y.entity, z.entity, -1) AS entity FROM asked q {_JOINS}),
{TQ._SURFACE.replace('FROM surface_dictionary WHERE surface IS NOT NULL', 'FROM short')},
resolved AS MATERIALIZED (SELECT s.wiki, s.target, c.clean AS surface, a.entity, b.entity AS context FROM short s JOIN cleaned c USING (surface) JOIN known a ON a.wiki = s.wiki AND a.t = s.target JOIN known b ON b.wiki = s.wiki AND b.t = s.context)"""
_R = f"WITH {_RESOLVED}"
query("surface_entity_counts", f"{_R} SELECT surface, entity, count(*) AS n FROM resolved WHERE entity >= 0 AND surface <> '' GROUP BY ALL")(lambda s, d: K.surface_counts(_resolved(s, d)))
query("surface_context_counts", f"{_R} SELECT surface, context AS entity, count(*) AS n FROM resolved WHERE entity >= 0 AND surface <> '' GROUP BY ALL")(lambda s, d: K.surface_counts(_resolved(s, d), "context"))
query("surface_vocabulary", f"{_R} SELECT DISTINCT surface FROM resolved WHERE entity >= 0 AND surface <> ''")(lambda s, d: K.vocabulary(_resolved(s, d)))
query(
    "resolve_diagnostics",
    f"{_R} SELECT count(*) AS n_links, count(*) FILTER (entity < 0) AS missing, count(*) FILTER (surface = '') AS unusable, "
    "(SELECT array_to_string(list_sort(list(x)), ' | ') FROM (SELECT wiki || '/' || target AS x FROM (SELECT DISTINCT wiki, target FROM resolved WHERE entity < 0) ORDER BY wiki, target LIMIT 10)) AS samples FROM resolved",
)(lambda s, d: K.diagnostics(_resolved(s, d)))
query(
    "acceptable_surface",
    rf"{_R}, vocabulary AS (SELECT DISTINCT surface FROM resolved WHERE entity >= 0 AND surface <> '') SELECT DISTINCT r.surface, r.surface <> '' AND NOT regexp_matches(r.surface, '^\d+$') AND NOT regexp_matches(r.surface, '^\d+(?:st|nd|rd|th)$') AND NOT regexp_matches(r.surface, '^[\d\s.,/:;%()+-]*$') AND r.surface IN (SELECT surface FROM vocabulary) AS ok FROM resolved r",
)(lambda s, d: (lambda r: r.select("surface").distinct().join(K.vocabulary(r).withColumn("known", F.lit(True)), "surface", "left").select("surface", (X.acceptable_surface(F.col("surface")) & F.coalesce("known", F.lit(False))).alias("ok")))(_resolved(s, d)))
_OF_LINKS = f"dictionary AS MATERIALIZED (SELECT surface AS surface_id, entity, count(*) AS cnt FROM resolved WHERE entity >= 0 AND surface <> '' GROUP BY ALL)"
_EXTRA = _RESOLVED.removeprefix(f"{M._RECORDS}, {M.ENTITIES}, ")
_TAGGED = MQ.PROMOTED.replace(M.DICTIONARY, f"{_EXTRA}, {_OF_LINKS}").replace("THEN CASE WHEN bc > 5 THEN b END", "THEN b")


def _repair(s, d, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dictionary of the links (surface, entity, cnt), its transitions by one promotion, and what the promotion leaves."""
    e = MQ._edges(s, d)
    own = storage.cut(K.surface_counts(resolved).withColumnRenamed("n", "cnt"), "links")
    rows = L.flag(L.flag(L.start(own.withColumnRenamed("surface", "surface_id")), MQ._kind(s, d, e, "human", "film"), "cond"), MQ._kind(s, d, e, "city", "country", "river"), "alt")
    moved = storage.cut(L.promote(rows, F.col("cond"), F.col("alt"), 0).select("surface_id", "old_entity", "cnt", "entity"), "promoted")
    return own, moved.withColumnRenamed("surface_id", "surface"), L.reduce_values(moved).withColumnRenamed("surface_id", "surface")


@query(
    "obtain_mentions",
    rf"""WITH {_TAGGED}, tagged AS (SELECT a.article_id, a.pos, c.clean AS surface, k.entity FROM anchors a JOIN cleaned c ON c.surface = a.anchor JOIN known k ON k.wiki = a.wiki AND k.t = a.target),
sizes AS (SELECT surface_id, count(*) AS n_candidates, sum(cnt) AS total FROM reduced GROUP BY surface_id),
moved AS (SELECT t.article_id, t.pos, t.surface, p.entity FROM tagged t LEFT JOIN promoted p ON p.surface_id = t.surface AND p.old_entity = t.entity)
SELECT m.article_id, m.pos, m.surface, r.entity, CASE WHEN r.entity IS NOT NULL THEN n_candidates END AS n_candidates, r.cnt FROM moved m LEFT JOIN (reduced r JOIN sizes z USING (surface_id)) ON r.surface_id = m.surface AND r.entity = m.entity
    AND 100.0 * r.cnt / total >= 5 AND NOT regexp_matches(m.surface, '^\d+$') AND NOT regexp_matches(m.surface, '^\d+(?:st|nd|rd|th)$') AND NOT regexp_matches(m.surface, '^[\d\s.,/:;%()+-]*$')""",
)
def obtain_mentions(s, d) -> DataFrame:
    """Links to tags: cleaned, acceptable, looked up, moved by the transitions of a promotion, with at least 5 % of their surface's counts."""
    resolved = _resolved(s, d)
    own, transitions, repaired = _repair(s, d, resolved)
    links = storage.cut(TQ._anchors(s, d), "anchors")
    short = K.resolve(resolved.select("wiki", "target"), storage.cut(M.titles(s, d), "titles"), TQ._redirects(s, d))
    known = links.join(short, ["wiki", "target"]).select(F.col("article_id").alias("doc"), "pos", X.clean_surface(F.col("anchor")).alias("surface"), "entity")
    return K.obtain_tags(known, own, transitions, repaired, min_percent=5).withColumnRenamed("doc", "article_id")
