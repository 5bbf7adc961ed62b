"""Queries on sources and generated documents, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.paths import js_round
from tidewright.lexicons.words import AGENT_TYPES
from tidewright.operators import keyvalue as KV
from tidewright.operators.changefeed import change_kind
from tidewright.operators.messages import micros
from tidewright.plans.problems import read
from tidewright.sources import cms, events as EV, routes as RT, sitemap as SM

BASE, DAY = "https://site.example", "2020-02-01"


def entries(spark, sf):
    e = SM.entries_of(read(spark, sf, "routes"), BASE, DAY, ("^/partners",))
    loc = F.when(F.col("route_ord") % 5 == 0, F.concat("loc", F.lit("?a=1&b='x'"))).otherwise(F.col("loc"))
    return e.withColumn("loc", loc).withColumn("priority", (F.col("route_ord") % 10) / 10)


def files(spark, sf):
    return SM.sitemap_files(entries(spark, sf), 100)


def snk01_entries(spark, sf):
    return SM.entries_of(read(spark, sf, "routes"), BASE, DAY, ("^/partners", "glossary")).select("loc", "lastmod", "changefreq", "priority")


def snk01_url_elements(spark, sf):
    e = entries(spark, sf)
    return e.select("route_ord", SM.url_element(F.col("loc"), F.col("lastmod"), F.col("changefreq"), F.col("priority")).alias("xml"))


def snk02_sitemap_files(spark, sf):
    return files(spark, sf).select("chunk", "urls", F.length("xml").alias("chars"), F.md5("xml").alias("digest"))


def snk02_sitemap_index(spark, sf):
    return SM.index_file(files(spark, sf).select("chunk"), BASE, DAY)


def src01_parsed_sitemap(spark, sf):
    return SM.parse_sitemap(files(spark, sf), "xml")


def src01_parsed_bad_sitemap(spark, sf):
    """Blocks with blanks, odd frequencies, priorities and dates, comments and addresses that do not count."""
    r = read(spark, sf, "routes")
    n = F.col("route_ord")
    loc = F.when(n % 7 == 0, "ftp://x.example/a").when(n % 7 == 1, "").otherwise(F.concat(F.lit("  " + BASE), "path", F.lit("?a=1&b=2 \n")))
    xml = F.concat(F.lit('<?xml version="1.0"?>\n<!-- <url><loc>/no</loc></url> -->\n<urlset><URL>\n <loc>'), loc, F.lit("</loc>\n <lastmod>"), F.when(n % 3 == 0, "yesterday").otherwise(" 2020-01-02T03:04 "),
                   F.lit("</lastmod> <changefreq> "), F.when(n % 2 == 0, "DAILY").otherwise("often"), F.lit("</changefreq><priority>"), F.when(n % 4 == 0, "1.5").when(n % 4 == 1, "x").otherwise("0.7"), F.lit("</priority></URL></urlset>"))
    return SM.parse_sitemap(r.select("route_ord", xml.alias("xml")), "xml", keep=("route_ord",))


def src02_decoded_entities(spark, sf):
    r = read(spark, sf, "routes")
    return r.select("route_ord", SM.decode_entities(F.concat(F.lit("&lt;a&gt; &#65;&#x42;&quot; "), "path", F.lit(" &#233;&amp;lt;"))).alias("text"))


def src03_index_children(spark, sf):
    return snk02_sitemap_index(spark, sf).select(F.explode(SM.parse_index(F.col("xml"))).alias("loc"), SM.is_index(F.col("xml")).alias("is_index"))


def src07_entry_routes(spark, sf):
    return src01_parsed_sitemap(spark, sf).select("loc", RT.entry_route(F.col("loc")).alias("path"), RT.entry_route(F.col("loc"), BASE).alias("behind_base"))


def src09_file_routes(spark, sf):
    n = F.col("route_ord")
    r = read(spark, sf, "routes")
    pre = F.when(n % 6 == 0, "/(group)").when(n % 6 == 1, "/_private").when(n % 6 == 2, "/api").when(n % 6 == 3, "/@slot").otherwise("")
    file = F.concat(F.lit("src/app"), pre, "path", F.when(n % 5 == 0, "/layout.tsx").when(n % 5 == 1, "/page.jsx").otherwise("/page.tsx"))
    return r.select(file.alias("file"), RT.file_route(file).alias("route"))


def src10_routes_of_sources(spark, sf):
    r = read(spark, sf, "routes").select("path", F.col("route_source").alias("source"), F.col("route_ord").alias("ord"))
    seen = read(spark, sf, "geo_events").where("route_details.matched_path is not null").groupBy(F.col("route_details.matched_path").alias("path")).agg(F.min("delivery_id").alias("ord"))
    more = read(spark, sf, "cms_events").where("path is not null").groupBy("path").agg(F.min("feed_seq").alias("ord"))
    one = r.where("source = 'manual'").withColumn("ord", F.col("ord").cast("long"))
    two, three = seen.select("path", F.lit("log").alias("source"), "ord"), more.select("path", F.lit("cms").alias("source"), "ord")
    return RT.first_of_sources([one, two, three])


def jn07_dynamic_routes(spark, sf):
    """Requested paths against patterns made of the routes: the last segment is a wildcard. Equal numbers of segments are joined, then tested."""
    pat = read(spark, sf, "routes").where(F.size(F.split("path", "/")) > 2).select(F.regexp_replace("path", "/[^/]+$", "/[id]").alias("route")).distinct()
    pat = pat.select("route", F.size(F.split("route", "/")).alias("n"), F.regexp_extract("route", "^(/[^/]+)", 1).alias("head"), RT.dynamic_pattern(F.col("route")).alias("pattern"))
    req = read(spark, sf, "geo_events").select(F.col("route_details.requested_path").alias("path")).where("path is not null").distinct()
    req = req.select("path", F.size(F.split("path", "/")).alias("n"), F.regexp_extract("path", "^(/[^/]+)", 1).alias("head"))
    return req.join(pat, ["n", "head"]).where(F.expr("path rlike pattern")).select("path", "route")


def src14_normalized(spark, sf):
    """Payloads in each platform's own form, made of the feed, and normalized back."""
    c = read(spark, sf, "cms_events").where(F.col("platform").isin(list(cms.FIELDS)))
    ts = F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    slug = F.substring("path", 2, 1000)
    loc = lambda x: F.struct(x.alias("en-US"))
    raw = (
        F.when(F.col("platform") == "contentful", F.to_json(F.struct(F.struct(F.col("content_id").alias("id"), F.col("content_type").alias("type"), ts.alias("updatedAt")).alias("sys"), F.col("event").alias("topic"),
               F.struct(loc(F.col("title")).alias("title"), loc(F.col("content")).alias("body"), loc(slug).alias("slug")).alias("fields"))))
        .when(F.col("platform") == "sanity", F.to_json(F.struct(F.col("content_id").alias("_id"), F.col("content_type").alias("_type"), ts.alias("_updatedAt"), F.col("event").alias("operation"), F.col("title"),
               F.struct(slug.alias("current")).alias("slug"), F.col("content").alias("body"))))
        .when(F.col("platform") == "strapi", F.to_json(F.struct(F.col("event"), F.col("content_type").alias("model"), F.struct(F.nullif(F.col("content_id"), F.lit("")).alias("id"), F.col("title"), slug.alias("slug"), F.col("content"), ts.alias("updatedAt")).alias("entry"))))
        .otherwise(F.to_json(F.struct(F.col("event").alias("action"), F.struct(F.col("content_id").alias("ID"), F.col("title").alias("post_title"), F.col("content").alias("post_content"), slug.alias("post_name"), F.col("content_type").alias("post_type"), ts.alias("post_modified")).alias("post"))))
    )
    n = cms.normalized(c.select("platform", raw.alias("payload")))
    return n.select("platform", "content_id", "event", "path", "title", "content", micros(F.col("last_modified")).alias("us")).where("content_id <> ''")


def snk04_llms_routes(spark, sf):
    return read(spark, sf, "routes").select("route_ord", F.concat("path", F.lit(" - "), "route_source").alias("line"))


def snk05_manifest_counts(spark, sf):
    """Routes of a manifest by their first segment."""
    seg = F.element_at(F.split("path", "/"), 2)
    return read(spark, sf, "routes").groupBy(seg.alias("section")).agg(F.count("*").alias("routes"), F.array_join(F.array_sort(F.collect_set("route_source")), ",").alias("sources"))


def snk08_route_events(spark, sf):
    e = read(spark, sf, "geo_events").where("route_details.requested_path is not null")
    parts = EV.route_event(F.col("route_details.requested_path"), F.col("route_details.matched_path"), F.col("route_details.match_method"))
    return e.select("delivery_id", *[c.alias(k) for k, c in parts.items()])


def snk09_flat_events(spark, sf):
    f = EV.flattened(read(spark, sf, "geo_events"))
    pairs = F.transform(F.array_sort(F.map_keys("params")), lambda k: F.concat(k, F.lit("="), F.element_at("params", k)))
    return f.select("delivery_id", "name", F.array_join(pairs, ";").alias("params"))


def snk12_not_found(spark, sf):
    e = read(spark, sf, "geo_events").where("route_details.match_method = 'none' and route_details.requested_path is not null")
    p = EV.not_found_payload(F.col("route_details.requested_path"), F.array().cast("array<string>"))
    return e.select("delivery_id", p.alias("p")).select("delivery_id", "p.error", "p.code", "p.message", "p.timed_out")


def writes(spark, sf):
    c = read(spark, sf, "cms_events").where("content_id is not null")
    gone = change_kind(F.col("event")) == "deleted"
    return c.select(F.concat_ws(":", "platform", F.trim("content_id")).alias("key"), F.when(~gone, F.coalesce("title", F.lit(""))).alias("value"), F.col("feed_seq").alias("seq"),
                    F.when(F.col("feed_seq") % 3 == 0, micros(F.col("received_at")) + 432_000_000_000).alias("expires_at"))


def snk13_current_values(spark, sf):
    return KV.current_values(writes(spark, sf), F.lit(1580515200000000))


def snk13_matching_keys(spark, sf):
    return KV.matching(snk13_current_values(spark, sf), "word*s:1*").select("key")


def flt10_valid_records(spark, sf):
    """Whether a logged miss is well formed: known agent (one crawler is not in the list), confidence within 0 and 1, a path, a time that is not negative."""
    e = read(spark, sf, "geo_events").where("route_details.requested_path is not null")
    known = F.coalesce("agent_type", F.lit("")).isin([a for a in AGENT_TYPES if a != "Bing"])
    conf, ms = F.coalesce("route_details.confidence", F.lit(-1.0)), F.coalesce("geo_metrics.processing_time_ms", F.lit(-1.0))
    return e.select("delivery_id", (known & conf.between(0, 1) & (ms >= 0) & F.col("event_ts").isNotNull()).alias("valid"))


def src18_imported_counts(spark, sf):
    """Counts of two logs of the same paths, merged by the greater."""
    e = read(spark, sf, "geo_events").where("route_details.requested_path is not null").select(F.col("route_details.requested_path").alias("path"), "ingest_batch")
    a = e.where("ingest_batch % 2 = 0").groupBy("path").agg(F.count("*").alias("a"))
    b = e.where("ingest_batch % 2 = 1").groupBy("path").agg(F.count("*").alias("b"))
    return a.join(b, "path", "full").select("path", F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("hits"))


# ---------------------------------------------------------------- SQL twins
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_ENT = f"""e AS (SELECT route_ord, '{BASE}' || path || CASE WHEN route_ord % 5 = 0 THEN '?a=1&b=''x''' ELSE '' END AS loc, '{DAY}' AS lastmod, 'weekly' AS changefreq, (route_ord % 10) / 10 AS priority
    FROM routes WHERE path NOT LIKE '/partners%')"""
_XML = f"""x AS (SELECT route_ord, '  <url>' || chr(10) || '    <loc>' || {_ESC.format('loc')} || '</loc>' || chr(10) || '    <lastmod>' || lastmod || '</lastmod>' || chr(10) || '    <changefreq>' || changefreq || '</changefreq>' || chr(10)
    || '    <priority>' || printf('%.1f', priority) || '</priority>' || chr(10) || '  </url>' || chr(10) AS xml FROM e)"""
_FILES = f"""f AS (SELECT chunk, count(*) AS urls, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg(xml, '' ORDER BY route_ord) || '</urlset>' || chr(10) AS xml
    FROM (SELECT *, (row_number() OVER (ORDER BY route_ord) - 1) // 100 AS chunk FROM x) GROUP BY 1)"""
_E = "lower(trim(event))"
_KIND = f"""CASE WHEN regexp_matches({_E}, '(unpublish|trash)(ed)?$') THEN 'unpublished' WHEN regexp_matches({_E}, 'publish(ed)?$') THEN 'published'
    WHEN regexp_matches({_E}, 'deleted?$') THEN 'deleted' WHEN regexp_matches({_E}, 'created?$') THEN 'created' ELSE 'updated' END"""
_KV = f"""w AS (SELECT platform || ':' || trim(content_id) AS key, CASE WHEN {_KIND} <> 'deleted' THEN coalesce(title, '') END AS value, feed_seq AS seq,
    CASE WHEN feed_seq % 3 = 0 THEN epoch_us(received_at) + 432000000000 END AS expires_at FROM cms_events WHERE content_id IS NOT NULL),
kv AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM w) WHERE k = 1 AND value IS NOT NULL AND (expires_at IS NULL OR expires_at > 1580515200000000))"""
_PARAMS = ["'event_category=' || event_category", "'event_action=' || event_action", "'session_id=' || session_id", "'client_id=' || client_id", "'page_location=' || page_location", "'page_title=' || page_title",
           "'agent_type=' || agent_type", "'is_ai_agent=' || is_ai_agent", "'fact_density_score=' || floor(geo_metrics.fact_density_score * 100 + 0.5)::BIGINT", "'processing_time_ms=' || floor(geo_metrics.processing_time_ms + 0.5)::BIGINT",
           "'requested_path=' || route_details.requested_path", "'matched_path=' || route_details.matched_path", "'match_method=' || route_details.match_method"]
_SEG = "list_filter(string_split({0}, '/'), lambda s: s <> '')"

ORACLES = {
    "snk01_entries": f"SELECT '{BASE}' || path AS loc, '{DAY}' AS lastmod, 'weekly' AS changefreq, 0.5::DOUBLE AS priority FROM routes WHERE path NOT LIKE '/partners%' AND NOT contains(path, 'glossary')",
    "snk01_url_elements": f"WITH {_ENT}, {_XML} SELECT route_ord, xml FROM x",
    "snk02_sitemap_files": f"WITH {_ENT}, {_XML}, {_FILES} SELECT chunk, urls, length(xml) AS chars, md5(xml) AS digest FROM f",
    "snk02_sitemap_index": f"""WITH {_ENT}, {_XML}, {_FILES} SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg('  <sitemap>' || chr(10) || '    <loc>{BASE}/sitemap-' || chunk || '.xml</loc>' || chr(10) || '    <lastmod>{DAY}</lastmod>' || chr(10) || '  </sitemap>' || chr(10), '' ORDER BY chunk) || '</sitemapindex>' || chr(10) AS xml FROM f""",
    "src01_parsed_sitemap": f"WITH {_ENT} SELECT loc, lastmod, changefreq, priority FROM e",
    "src01_parsed_bad_sitemap": f"""SELECT route_ord, '{BASE}' || path || '?a=1&b=2' AS loc, CASE WHEN route_ord % 3 <> 0 THEN '2020-01-02T03:04' END AS lastmod, CASE WHEN route_ord % 2 = 0 THEN 'daily' END AS changefreq,
        CASE WHEN route_ord % 4 >= 2 THEN 0.7::DOUBLE END AS priority FROM routes WHERE route_ord % 7 > 1""",
    "src02_decoded_entities": "SELECT route_ord, '<a> AB\" ' || path || ' é<' AS text FROM routes",
    "src03_index_children": f"WITH {_ENT}, {_XML}, {_FILES} SELECT '{BASE}/sitemap-' || chunk || '.xml' AS loc, true AS is_index FROM f",
    "src07_entry_routes": f"""WITH {_ENT} SELECT loc, CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/$', '') END AS path, regexp_replace(substr(loc, {len(BASE) + 1}), '(.)/$', '\\1') AS behind_base
        FROM (SELECT loc, regexp_replace(regexp_replace(loc, '^https?://[^/?#]*', ''), '[?#].*$', '') AS path FROM e)""",
    "src09_file_routes": """SELECT 'src/app' || pre || path || f AS file, CASE WHEN f LIKE '/page%' AND pre IN ('', '/(group)') THEN path END AS route FROM (SELECT path, CASE route_ord % 6 WHEN 0 THEN '/(group)' WHEN 1 THEN '/_private' WHEN 2 THEN '/api' WHEN 3 THEN '/@slot' ELSE '' END AS pre,
        CASE route_ord % 5 WHEN 0 THEN '/layout.tsx' WHEN 1 THEN '/page.jsx' ELSE '/page.tsx' END AS f FROM routes)""",
    "src10_routes_of_sources": """WITH u AS (SELECT path, 'manual' AS source, 0 AS source_no, route_ord AS ord FROM routes WHERE route_source = 'manual' UNION ALL
        SELECT route_details.matched_path, 'log', 1, min(delivery_id) FROM geo_events WHERE route_details.matched_path IS NOT NULL GROUP BY 1 UNION ALL SELECT path, 'cms', 2, min(feed_seq) FROM cms_events WHERE path IS NOT NULL GROUP BY 1)
        SELECT path, source, source_no, ord FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY source_no, ord) = 1""",
    "jn07_dynamic_routes": f"""WITH q AS (SELECT DISTINCT route_details.requested_path AS path FROM geo_events WHERE route_details.requested_path IS NOT NULL), r AS (SELECT DISTINCT regexp_replace(path, '/[^/]+$', '/[id]') AS route FROM routes WHERE len(string_split(path, '/')) > 2)
        SELECT path, route FROM q JOIN r ON len(string_split(path, '/')) = len(string_split(route, '/')) AND regexp_extract(path, '^(.*)/[^/]+$', 1) = regexp_extract(route, '^(.*)/[^/]+$', 1)""",
    "src14_normalized": f"""SELECT platform, CASE WHEN platform = 'strapi' AND coalesce(content_id, '') = '' THEN content_type ELSE content_id END AS content_id, 'content.' || {_KIND} AS event, CASE WHEN length(path) > 1 THEN path END AS path,
        coalesce(title, '') AS title, coalesce(content, '') AS content, epoch_us(last_modified) AS us FROM cms_events WHERE platform IN ('contentful', 'sanity', 'strapi', 'wordpress') AND (coalesce(content_id, '') <> '' OR platform = 'strapi' AND coalesce(content_type, '') <> '')""",
    "snk04_llms_routes": "SELECT route_ord, path || ' - ' || route_source AS line FROM routes",
    "snk05_manifest_counts": "SELECT string_split(path, '/')[2] AS section, count(*) AS routes, string_agg(DISTINCT route_source, ',' ORDER BY route_source) AS sources FROM routes GROUP BY 1",
    "snk08_route_events": """SELECT delivery_id, CASE WHEN ok THEN 'geo_route_redirected' ELSE 'geo_route_not_found' END AS event_name, 'route_resolution' AS category, CASE WHEN ok THEN 'redirected' ELSE 'not_found' END AS action, p AS page_location
        FROM (SELECT delivery_id, route_details.requested_path AS p, coalesce(route_details.matched_path IS NOT NULL AND route_details.match_method <> 'none', false) AS ok FROM geo_events) WHERE p IS NOT NULL""",
    "snk09_flat_events": f"""SELECT delivery_id, event_name AS name, array_to_string(list_sort(list_filter(list_concat([{', '.join(_PARAMS)}], list_transform(map_entries(custom_dimensions), lambda e: 'custom_' || e.key || '=' || e.value)), lambda s: s IS NOT NULL)), ';') AS params FROM geo_events""",
    "snk12_not_found": """SELECT delivery_id, 'NOT_FOUND' AS error, 404 AS code, 'The requested path "' || p || '" was not found.' AS message, false AS timed_out FROM (SELECT delivery_id, route_details.requested_path AS p, route_details.match_method AS m FROM geo_events) WHERE m = 'none' AND p IS NOT NULL""",
    "snk13_current_values": f"WITH {_KV} SELECT key, value FROM kv",
    "snk13_matching_keys": f"WITH {_KV} SELECT key FROM kv WHERE regexp_full_match(key, 'word.*s:1.*')",
    "flt10_valid_records": f"""SELECT delivery_id, coalesce(agent_type, '') IN ({', '.join(repr(a) for a in AGENT_TYPES if a != 'Bing')}) AND coalesce(c, -1) BETWEEN 0 AND 1 AND coalesce(ms, -1) >= 0 AND event_ts IS NOT NULL AS valid
        FROM (SELECT delivery_id, agent_type, event_ts, route_details.confidence AS c, geo_metrics.processing_time_ms AS ms, route_details.requested_path AS p FROM geo_events) WHERE p IS NOT NULL""",
    "src18_imported_counts": """WITH e AS (SELECT route_details.requested_path AS path, ingest_batch FROM geo_events) SELECT path, greatest(count(*) FILTER (ingest_batch % 2 = 0), count(*) FILTER (ingest_batch % 2 = 1)) AS hits
        FROM e WHERE path IS NOT NULL GROUP BY 1 HAVING count(ingest_batch) > 0""",
}
QUERIES = {f.__name__: f for f in (
    snk01_entries, snk01_url_elements, snk02_sitemap_files, snk02_sitemap_index, src01_parsed_sitemap, src01_parsed_bad_sitemap, src02_decoded_entities, src03_index_children, src07_entry_routes, src09_file_routes,
    src10_routes_of_sources, jn07_dynamic_routes, src14_normalized, snk04_llms_routes, snk05_manifest_counts, snk08_route_events, snk09_flat_events, snk12_not_found, snk13_current_values, snk13_matching_keys,
    flt10_valid_records, src18_imported_counts)}
