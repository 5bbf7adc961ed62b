"""Queries on stored records and built events, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import authority as A, entities as E, paths as P
from tidewright.lexicons import words as W
from tidewright.operators import logs as LG, records as R
from tidewright.plans import authority as QA, content as QC, entities as QE, logs as QL, routing as Q
from tidewright.plans.content import lit
from tidewright.plans.problems import read
from tidewright.sources import events as EV, sitemap as SM

THRESHOLD = 3


def redirects(spark, sf):
    e = read(spark, sf, "geo_events").where("route_details.match_method = 'semantic'")
    e = e.select(F.col("route_details.requested_path").alias("from_path"), F.col("route_details.matched_path").alias("to_path"), F.col("delivery_id").alias("seq"))
    return e.where("from_path is not null and to_path is not null")


def manual(spark, sf):
    """Every seventh path that was ever redirected has an alias made by hand."""
    r = redirects(spark, sf).groupBy("from_path").agg(F.min("seq").alias("first"))
    return r.where("first % 7 = 0").select("from_path", F.lit("/by-hand").alias("to_path"), (F.col("first") + 100).alias("created_at"))


def _aliases(spark, sf):
    requests = Q.requests(spark, sf).select("path", F.col("delivery_id").alias("seq"))
    return R.alias_table(redirects(spark, sf), requests, THRESHOLD, manual(spark, sf))


def stm04_alias_table(spark, sf):
    return _aliases(spark, sf)


def stm04_pending_counts(spark, sf):
    return R.pending_counts(redirects(spark, sf), _aliases(spark, sf))


def flt04_manual_aliases(spark, sf):
    return _aliases(spark, sf).where(~F.col("auto")).select("from_path", "to_path")


def agg21_alias_stats(spark, sf):
    a = _aliases(spark, sf)
    return R.alias_stats(a, R.pending_counts(redirects(spark, sf), a))


def str14_reasoning(spark, sf):
    best = Q.jn03_best_match(spark, sf)
    p, r = P.tokenize_path(F.col("path")), P.tokenize_path(F.col("route"))
    return best.select("path", "route", R.reasoning(p, r, F.filter(p, lambda t: F.array_contains(r, t)), F.col("confidence")).alias("reasoning"))


def str19_ids(spark, sf):
    c = read(spark, sf, "discovered_citations")
    return c.select("citation_id", R.reproducible_id("cit", F.col("source_url"), F.col("title"), F.col("mention_context")).alias("id"))


def misses(spark, sf):
    e = read(spark, sf, "geo_events").where("route_details.requested_path is not null")
    outcome = F.when(F.col("route_details.match_method") == "none", "404").when(F.col("route_details.match_method") == "alias", "alias-used").otherwise("redirected")
    return e.select(F.coalesce("event_id", F.lit("")).alias("id"), F.col("event_ts").alias("timestamp"), F.col("route_details.requested_path").alias("path"), F.coalesce("route_details.confidence", F.lit(0.0)).alias("confidence"),
                    "agent_type", outcome.alias("outcome"), F.col("geo_metrics.processing_time_ms").alias("latency_ms"), "delivery_id")


MISS = "id string, timestamp timestamp, path string, confidence double, agent_type string, outcome string, latency_ms double, delivery_id long"


def snk07_exported(spark, sf):
    """What a reader of the exported documents sees."""
    d = R.exported(misses(spark, sf).drop("latency_ms", "confidence"))
    g = lambda n: F.get_json_object("json", f"$.{n}").alias(n)
    return d.select(g("delivery_id"), g("id"), g("timestamp"), g("path"), g("agent_type"), g("outcome"))


def src18_imported_misses(spark, sf):
    """The exported log read again; only what is valid comes in, every ninth document being broken."""
    d = R.exported(misses(spark, sf))
    n = F.get_json_object("json", "$.delivery_id").cast("long")
    return R.imported(d.select(F.when(n % 9 == 0, F.substring("json", 2, 50)).otherwise(F.col("json")).alias("json")), MISS, R.valid_miss).select("delivery_id", F.unix_micros("timestamp").alias("us"), "path", "agent_type", "outcome")


def src18_kept_aliases(spark, sf):
    """Imported aliases do not replace those that are there."""
    own = _aliases(spark, sf).where(F.col("auto")).select("from_path", "to_path")
    new = redirects(spark, sf).groupBy("from_path").agg(F.max("to_path").alias("to_path"))
    return R.kept_existing(own, new, "from_path")


def flt10_valid_aliases(spark, sf):
    a = _aliases(spark, sf).select("from_path", F.struct(R.reproducible_id("alias", F.col("from_path")).alias("id"), "from_path", "to_path", "hits", "created_at", "last_used_at", "auto").alias("r"))
    return a.select("from_path", R.valid_alias(F.col("r")).alias("valid"))


def flt10_valid_visits(spark, sf):
    e = read(spark, sf, "geo_events")
    r = F.struct(F.col("event_id").alias("id"), F.col("event_ts").alias("timestamp"), F.col("page_location").alias("path"), "agent_type", (F.col("route_details.match_method") != "none").alias("was_redirected"), "session_id")
    return e.select("delivery_id", R.valid_visit(r).alias("valid"))


def flt10_valid_measurements(spark, sf):
    r = read(spark, sf, "routes")
    return r.select("route_ord", R.valid_measurement(F.concat(F.when(F.col("route_ord") % 3 == 0, "G-").otherwise("UA-"), "path"), F.when(F.col("route_ord") % 2 == 0, "secret").when(F.col("route_ord") % 5 == 0, "")).alias("valid"))


def aut02_scores(spark, sf):
    """Known domains, then what a service said, then the name alone, with the source and how sure it is."""
    told = {k: (s + 7) % 100 for k, s in W.DOMAIN_AUTHORITY[::2]}
    return A.domain_scores(QA.names(spark, sf), "domain", spark.createDataFrame(list(told.items()), "domain string, score int"))


def snk08_page_events(spark, sf):
    d = QC.txt09_density(spark, sf)
    parts = EV.page_event(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "Human").when(F.col("doc_id") % 3 == 0, "Claude"), {"fact_density_score": F.col("score")})
    return d.select("doc_id", *[c.alias(k) for k, c in parts.items()]).select("*", "metrics.*").drop("metrics")


def snk08_citation_events(spark, sf):
    c = read(spark, sf, "discovered_citations")
    parts = EV.citation_event(F.lower("source_domain"), F.col("domain_authority"), F.coalesce("sentiment", F.lit("neutral")), F.col("is_earned_media"))
    return c.select("citation_id", *[x.alias(k) for k, x in parts.items()]).select("citation_id", "event_name", "category", "action", "details.*")


def snk08_schema_events(spark, sf):
    d = E.with_entities(QC.docs(spark, sf), "t").withColumn("types", F.transform("entities", lambda e: e["type"]))
    parts = EV.schema_event(F.col("doc_id").cast("string"), F.col("types"), F.array_contains("types", "Article"), F.size("types") > 0)
    return d.select("doc_id", *[c.alias(k) for k, c in parts.items()]).select("doc_id", "event_name", "page_location", F.size("details.entity_types").alias("types"), "details.validation_passed")


def snk08_agent_events(spark, sf):
    r = QL.requests(spark, sf)
    a = LG.agent_of_request(F.col("ua"), F.col("accept"))
    parts = EV.agent_event(F.col("delivery_id").cast("string"), a["type"], a["confidence"], F.array(a["signal"]))
    return r.select("delivery_id", *[c.alias(k) for k, c in parts.items()])


def snk08_freshness_events(spark, sf):
    p = QL.dt03_freshness(spark, sf)
    return p.select("path", *[c.alias(k) for k, c in EV.freshness_event(F.col("path"), F.col("is_stale"), F.col("refresh_priority")).items()])


def snk04_llms_lines(spark, sf):
    """The document for machine readers, line by line: heading, quick facts, pages, time of the last change."""
    facts = QC.sents(spark, sf).where((F.length("s") > 20) & (F.length("s") < 200) & QC.S.has_statistic(F.col("s"))).orderBy("doc_id", "pos").limit(10)
    line = lambda section, a, b, text: (F.lit(section).alias("section"), a.cast("long").alias("a"), b.cast("long").alias("b"), text.alias("line"))
    zero = F.lit(0)
    fixed = [(0, 0, 0, "# llms.txt - AI Agent Manifest for Site"), (0, 1, 0, "> Pages of a site"), (0, 2, 0, ""), (1, -1, 0, "## Quick Facts"), (2, -1, 0, "## Key Pages"), (3, 0, 0, "## Last Updated: 2020-02-01T00:00:00.000Z")]
    out = spark.createDataFrame(fixed, "section int, a long, b long, line string")
    out = out.unionByName(facts.select(*line(1, F.col("doc_id"), F.col("pos"), F.concat(F.lit("- "), "s"))))
    return out.unionByName(read(spark, sf, "routes").select(*line(2, F.col("route_ord"), zero, F.concat("path", F.lit(" - "), "route_source"))))


def snk05_manifest(spark, sf):
    """The parts of a site's manifest: routes, intents and entities in order of kind and name."""
    routes = read(spark, sf, "routes").select(F.lit("route").alias("part"), F.col("path").alias("name"), F.col("route_source").alias("description"))
    intents = QC.txt28_intents(spark, sf).select(F.lit("intent").alias("part"), F.col("intent").alias("name"), F.concat(F.lit("on "), F.col("pages"), F.lit(" pages")).alias("description"))
    kinds = QC.txt28_manifest_entities(spark, sf).select(F.lit("entity").alias("part"), F.col("entity_type").alias("name"), F.concat(F.lit("found on page "), "first_page").alias("description"))
    return routes.unionByName(intents).unionByName(kinds)


def src06_plain_urls(spark, sf):
    """The plain reading of sitemaps: no decoding, no checks."""
    from tidewright.plans.sources import files

    return files(spark, sf).select("chunk", F.explode(SM.plain_entries(F.col("xml"))).alias("e")).select("chunk", "e.*")


def src08_discovered(spark, sf):
    """Routes in a tree of sitemaps: each first segment has one, and an index of every tenth segment leads on to the others and back."""
    r = read(spark, sf, "routes").select("path", F.element_at(F.split("path", "/"), 2).alias("seg"))
    none = F.array().cast("array<string>")
    leaves = r.groupBy("seg").agg(F.array_sort(F.collect_set("path")).alias("locs")).select(F.concat(F.lit("s/"), "seg").alias("url"), "locs", none.alias("children"))
    top = leaves.agg(F.collect_set("url").alias("all")).select(F.lit("root").alias("url"), none.alias("locs"), F.concat(F.array(F.lit("root"), F.lit("gone")), F.array_sort("all")).alias("children"))
    return R.discovered_routes(leaves.unionByName(top), "root")


from tidewright.plans.routing import _ALIAS, _REQ  # noqa: E402

_AL = f"""{_ALIAS}, {_REQ}, mn AS (SELECT from_path, '/by-hand' AS to_path, false AS auto, min(seq) + 100 AS created_at FROM al0 GROUP BY 1 HAVING min(seq) % 7 = 0),
    un AS (SELECT from_path, to_path, true AS auto, learned_at AS created_at FROM al UNION ALL FROM mn), fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_path ORDER BY created_at, auto, to_path) AS k FROM un) WHERE k = 1),
    us AS (SELECT from_path, count(*) AS hits, max(delivery_id) AS last FROM fi JOIN req ON path = from_path AND delivery_id > created_at GROUP BY 1),
    ta AS (SELECT from_path, to_path, auto, created_at, coalesce(hits, 0) AS hits, coalesce(last, created_at) AS last_used_at FROM fi LEFT JOIN us USING (from_path)),
    pe AS (SELECT al0.from_path, al0.to_path, count(*) AS count FROM al0 LEFT JOIN ta USING (from_path) WHERE created_at IS NULL OR (seq <= created_at AND al0.to_path <> ta.to_path) GROUP BY 1, 2)"""
_MISS = """mi AS (SELECT coalesce(event_id, '') AS id, event_ts AS timestamp, route_details.requested_path AS path, coalesce(route_details.confidence, 0.0) AS confidence, agent_type,
    CASE WHEN route_details.match_method = 'none' THEN '404' WHEN route_details.match_method = 'alias' THEN 'alias-used' ELSE 'redirected' END AS outcome, geo_metrics.processing_time_ms AS latency_ms, delivery_id
    FROM geo_events WHERE route_details.requested_path IS NOT NULL)"""
_MARK = lambda c: f"coalesce(length({c}) || ':' || {c}, '-')"
_TELLS = f"list_filter({Q.tok('path')}, lambda x: list_contains({Q.tok('route')}, x))"
_REST = lambda c: f"list_filter({Q.tok(c)}, lambda x: NOT list_contains({_TELLS}, x))"
_PCT = "printf('%.1f', round(confidence * 100, 1)) || '%'"
_TOLD = {k: (s + 7) % 100 for k, s in W.DOMAIN_AUTHORITY[::2]}
ORACLES = {
    "stm04_alias_table": f"WITH {_AL} SELECT * FROM ta",
    "stm04_pending_counts": f"WITH {_AL} SELECT * FROM pe",
    "flt04_manual_aliases": f"WITH {_AL} SELECT from_path, to_path FROM ta WHERE NOT auto",
    "agg21_alias_stats": f"WITH {_AL} SELECT count(*) AS total, sum(auto::INT)::BIGINT AS auto_generated, sum((NOT auto)::INT)::BIGINT AS manual, sum(hits)::BIGINT AS total_hits, (SELECT count(*) FROM pe) AS pending FROM ta",
    "str14_reasoning": f"""{Q._SCORED} SELECT path, route, CASE WHEN len({_TELLS}) = 0 THEN 'No common tokens found, but structure similarity is ' || {_PCT} ELSE 'Matched tokens: [' || array_to_string({_TELLS}, ', ') || ']'
        || CASE WHEN len({_REST('path')}) > 0 THEN '. Unmatched from request: [' || array_to_string({_REST('path')}, ', ') || ']' ELSE '' END || CASE WHEN len({_REST('route')}) > 0 THEN '. Additional in route: [' || array_to_string({_REST('route')}, ', ') || ']' ELSE '' END
        || '. Confidence: ' || {_PCT} END AS reasoning FROM best""",
    "str19_ids": f"SELECT citation_id, 'cit_' || substr(sha256({_MARK('source_url')} || '|' || {_MARK('title')} || '|' || {_MARK('mention_context')}), 1, 24) AS id FROM discovered_citations",
    "snk07_exported": f"WITH {_MISS} SELECT delivery_id::VARCHAR AS delivery_id, id, strftime(date_trunc('millisecond', timestamp), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, path, agent_type, outcome FROM mi",
    "src18_imported_misses": f"WITH {_MISS} SELECT delivery_id, epoch_us(date_trunc('millisecond', timestamp)) AS us, path, agent_type, outcome FROM mi WHERE delivery_id % 9 <> 0 AND id <> '' AND timestamp IS NOT NULL AND confidence BETWEEN 0 AND 1 AND agent_type IN ({', '.join(map(lit, R.AGENTS))}) AND latency_ms >= 0",
    "src18_kept_aliases": f"WITH {_AL} SELECT from_path, to_path FROM ta WHERE auto UNION ALL SELECT from_path, max(to_path) FROM al0 WHERE from_path NOT IN (SELECT from_path FROM ta WHERE auto) GROUP BY 1",
    "flt10_valid_aliases": f"WITH {_AL} SELECT from_path, starts_with(from_path, '/') AND starts_with(to_path, '/') AS valid FROM ta",
    "flt10_valid_visits": "SELECT delivery_id, event_id IS NOT NULL AND event_ts IS NOT NULL AND page_location IS NOT NULL AND agent_type IS NOT NULL AND route_details.match_method IS NOT NULL AND session_id IS NOT NULL AS valid FROM geo_events",
    "flt10_valid_measurements": "SELECT route_ord, route_ord % 6 = 0 AS valid FROM routes",
    "aut02_scores": f"""WITH {QA._NAMES}, s AS (SELECT domain, d, {QA._HEUR} AS h FROM p), t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in _TOLD.items())}) AS v(k, x))
        SELECT DISTINCT d AS domain, coalesce(x, h)::INT AS score, CASE WHEN x IS NULL THEN 'heuristic' ELSE 'api' END AS source, CASE WHEN x IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM s LEFT JOIN t ON d = k""",
    "snk08_page_events": f"SELECT doc_id, 'geo_page_analyzed' AS event_name, 'page_analysis' AS category, 'analyzed' AS action, doc_id::VARCHAR AS page_location, CASE WHEN doc_id % 2 = 0 THEN false WHEN doc_id % 3 = 0 THEN true END AS is_ai_agent, score AS fact_density_score FROM ({QC.ORACLES['txt09_density']})",
    "snk08_citation_events": "SELECT citation_id, 'geo_citation_discovered' AS event_name, 'citation_discovery' AS category, 'discovered' AS action, lower(source_domain) AS source_domain, domain_authority, coalesce(sentiment, 'neutral') AS sentiment, is_earned_media FROM discovered_citations",
    "snk08_schema_events": f"WITH {QE._FOUND} SELECT d.doc_id, 'geo_schema_generated' AS event_name, d.doc_id::VARCHAR AS page_location, count(e.doc_id)::INT AS types, count(e.doc_id) > 0 AS validation_passed FROM d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id",
    "snk08_agent_events": f"WITH {QL._REQ} SELECT delivery_id, 'geo_agent_detected' AS event_name, 'agent_detection' AS category, 'detected' AS action, delivery_id::VARCHAR AS page_location, a.t <> 'Human' AS is_ai_agent, a.c::DOUBLE AS confidence, a.s AS detection_signals FROM g",
    "snk08_freshness_events": f"SELECT path, CASE WHEN is_stale THEN 'geo_content_stale' ELSE 'geo_content_fresh' END AS event_name, 'freshness_check' AS category, CASE WHEN is_stale THEN 'stale_detected' ELSE 'analyzed' END AS action, path AS page_location, refresh_priority AS priority FROM ({QL.ORACLES['dt03_freshness']})",
    "snk04_llms_lines": f"""WITH {QC._S}, f AS (SELECT doc_id, pos, s FROM s WHERE length(s) > 20 AND length(s) < 200 AND {QC._STAT} ORDER BY doc_id, pos LIMIT 10)
        SELECT * FROM (VALUES (0, 0, 0, '# llms.txt - AI Agent Manifest for Site'), (0, 1, 0, '> Pages of a site'), (0, 2, 0, ''), (1, -1, 0, '## Quick Facts'), (2, -1, 0, '## Key Pages'), (3, 0, 0, '## Last Updated: 2020-02-01T00:00:00.000Z')) AS v(section, a, b, line)
        UNION ALL SELECT 1, doc_id, pos, '- ' || s FROM f UNION ALL SELECT 2, route_ord, 0, path || ' - ' || route_source FROM routes""",
    "snk05_manifest": f"SELECT 'route' AS part, path AS name, route_source AS description FROM routes UNION ALL SELECT 'intent', intent, 'on ' || pages || ' pages' FROM ({QC.ORACLES['txt28_intents']}) UNION ALL SELECT 'entity', entity_type, 'found on page ' || first_page FROM ({QC.ORACLES['txt28_manifest_entities']})",
    "src08_discovered": "SELECT DISTINCT path AS loc, 1 AS depth FROM routes",
}
QUERIES = {f.__name__: f for f in (
    stm04_alias_table, stm04_pending_counts, flt04_manual_aliases, agg21_alias_stats, str14_reasoning, str19_ids, snk07_exported, src18_imported_misses, src18_kept_aliases, flt10_valid_aliases, flt10_valid_visits,
    flt10_valid_measurements, aut02_scores, snk08_page_events, snk08_citation_events, snk08_schema_events, snk08_agent_events, snk08_freshness_events, snk04_llms_lines, snk05_manifest, src06_plain_urls, src08_discovered)}
