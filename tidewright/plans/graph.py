"""Queries on topic graphs and their SQL twins. The pages are the documents of each site, related by the topics of their whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import paths as P, structure as S
from tidewright.operators import topics as T
from tidewright.plans.content import _T
from tidewright.plans.problems import read
from tidewright.session import materialize, spread

LEAST = 0.3
SITE = ["site"]


def pages(spark, sf):
    d = spread(read(spark, sf, "documents")).select(F.col("doc_id").alias("page"), "site", S.topics(S.plain_lines(F.col("text"))).alias("topics"))
    return materialize(d, "pages")


def jn08_topic_pairs(spark, sf):
    return T.topic_pairs(pages(spark, sf), LEAST, SITE)


def flt14_symmetric(spark, sf):
    """Of all related pairs, as page and other page, from how many sides they are met and how many similarities are found."""
    return T.sides(pages(spark, sf), LEAST, SITE)


def jn09_orphans(spark, sf):
    return T.orphans(pages(spark, sf), LEAST, SITE)


def jn10_link_suggestions(spark, sf):
    return T.link_suggestions(pages(spark, sf), LEAST, SITE)


def gr01_clusters(spark, sf):
    return T.clusters(pages(spark, sf), LEAST, SITE)


def gr03_page_nodes(spark, sf):
    c = read(spark, sf, "cms_events")
    return c.select("feed_seq", "path", "title", P.topic_hash(F.col("content")).alias("content_hash"))


def gr04_reputation_clusters(spark, sf):
    """Domains that are mentioned with the same first title word on one day belong together."""
    c = read(spark, sf, "discovered_citations").where("source_domain is not null and discovered_at is not null")
    k = c.select("source_domain", F.lower(F.substring_index("title", " ", 2)).alias("w"), F.to_date("discovered_at").alias("d")).distinct()
    hub = k.groupBy("w", "d").agg(F.min("source_domain").alias("first"))
    edges = k.join(hub, ["w", "d"]).where("source_domain <> first").select(F.col("source_domain").alias("source"), F.col("first").alias("target")).distinct()
    return T.components(edges).select("node", "component")


from tidewright.lexicons.words import TOPIC_STOP_WORDS  # noqa: E402

_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower(t), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 3)"
_P = f"""{_T}, o AS (SELECT doc_id AS page, w, min(i) AS i FROM (SELECT doc_id, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT doc_id, {_WORDS} AS x FROM d)) WHERE w NOT IN ({', '.join(repr(w) for w in TOPIC_STOP_WORDS)}) GROUP BY 1, 2),
    z AS (SELECT page, site, w, i, count(*) OVER (PARTITION BY page) AS n FROM o JOIN documents ON page = doc_id)"""
_PAIRS = f"""WITH RECURSIVE {_P}, m AS (SELECT u.page AS a, v.page AS b, round(count(*) / (any_value(u.n) + any_value(v.n) - count(*)), 9) AS similarity, string_agg(u.w, ',' ORDER BY v.i) AS shared
    FROM z u JOIN z v ON u.site = v.site AND u.w = v.w AND u.page <> v.page GROUP BY 1, 2), s AS (SELECT a, b, similarity, shared FROM m WHERE a < b AND similarity >= 0.3)"""
_LONE = "l AS (SELECT doc_id AS page FROM documents WHERE doc_id NOT IN (SELECT a FROM s UNION ALL SELECT b FROM s))"
ORACLES = {
    "jn08_topic_pairs": f"{_PAIRS} SELECT a, b, similarity, shared FROM s",
    "flt14_symmetric": f"{_PAIRS} SELECT least(a, b) AS page, greatest(a, b) AS other, count(*) AS sides, count(DISTINCT similarity) AS similarities FROM m WHERE similarity >= 0.3 GROUP BY 1, 2",
    "jn09_orphans": f"{_PAIRS}, {_LONE} SELECT page FROM l",
    "jn10_link_suggestions": f"""{_PAIRS}, {_LONE}, k AS (SELECT page, b AS link_to, similarity, row_number() OVER (PARTITION BY page ORDER BY similarity DESC, b) AS k FROM l JOIN m ON page = a)
        SELECT page, link_to, similarity, CASE WHEN similarity > 0.5 THEN 'high' WHEN similarity > 0.3 THEN 'medium' ELSE 'low' END AS priority FROM k WHERE k = 1""",
    "gr01_clusters": f"""{_PAIRS}, e AS (SELECT a AS n, b AS m FROM s UNION ALL SELECT b, a FROM s), r(n, c) AS (SELECT n, n FROM e UNION SELECT e.n, r.c FROM e JOIN r ON e.m = r.n),
        c AS (SELECT n, min(c) AS component FROM r GROUP BY n), g0 AS (SELECT n, count(*) AS links FROM e GROUP BY n),
        g AS (SELECT component, count(*) AS pages, arg_min(n, ROW(-links, n)) AS central FROM c JOIN g0 USING (n) GROUP BY 1),
        w AS (SELECT component, w AS t, count(*) AS k FROM c JOIN o ON page = n GROUP BY 1, 2)
        SELECT component, pages, central, upper(substr(t, 1, 1)) || substr(t, 2) AS name FROM g JOIN (SELECT component, arg_min(t, ROW(-k, t)) AS t FROM w GROUP BY 1) USING (component)""",
    "gr04_reputation_clusters": """WITH RECURSIVE k AS (SELECT DISTINCT source_domain AS s, lower(array_to_string(string_split(title, ' ')[1:2], ' ')) AS w, discovered_at::DATE AS d FROM discovered_citations WHERE source_domain IS NOT NULL AND discovered_at IS NOT NULL),
        h AS (SELECT w, d, min(s) AS f FROM k GROUP BY 1, 2), e0 AS (SELECT DISTINCT s AS n, f AS m FROM k JOIN h USING (w, d) WHERE s <> f), e AS (SELECT * FROM e0 UNION SELECT m, n FROM e0),
        r(n, c) AS (SELECT n, n FROM e UNION SELECT e.n, r.c FROM e JOIN r ON e.m = r.n) SELECT n AS node, min(c) AS component FROM r GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (jn08_topic_pairs, flt14_symmetric, jn09_orphans, jn10_link_suggestions, gr01_clusters, gr03_page_nodes, gr04_reputation_clusters)}
