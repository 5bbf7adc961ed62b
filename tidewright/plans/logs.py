"""Queries on request logs, traffic, citations and freshness, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewright.functions.paths import js_round, url_domain
from tidewright.lexicons import words as W
from tidewright.operators import changefeed, citations as C, freshness as FR, logs as L, routing as R
from tidewright.operators.messages import micros
from tidewright.plans.problems import read
from tidewright.session import spread

NOW = "2020-03-01 00:00:00"


def misses(spark, sf):
    """The log of requested paths that are no routes."""
    m = F.col("route_details.match_method")
    outcome = F.when(m == "alias", "alias-used").when(m.isin("exact", "semantic"), "redirected").otherwise("404")
    return read(spark, sf, "geo_events").where("route_details.requested_path is not null").select(
        F.col("delivery_id").alias("id"), F.col("route_details.requested_path").alias("path"), outcome.alias("outcome"),
        F.coalesce("route_details.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("geo_metrics.processing_time_ms", F.lit(0.0)).alias("latency_ms"),
        F.coalesce("agent_type", F.lit("Human")).alias("agent_type"), micros(F.col("event_ts")).alias("us"))


def visits(spark, sf):
    return read(spark, sf, "geo_events").select(
        F.col("delivery_id").alias("id"), F.col("page_location").alias("path"), "agent_type", "client_id", micros(F.col("event_ts")).alias("us"),
        F.col("route_details.match_method").isin("alias", "semantic").alias("was_redirected"), "event_name", F.col("geo_metrics.processing_time_ms").alias("ms"))


def flt02_misses_in_range(spark, sf):
    return misses(spark, sf).where("outcome = '404' and agent_type = 'ChatGPT' and us between 1578787200000000 and 1579392000000000").select("id", "path", "us")


def flt03_agent_traffic(spark, sf):
    v = visits(spark, sf).where("us between 1578787200000000 and 1579392000000000")
    return v.groupBy(F.when(F.col("agent_type") == "Human", "human").when(F.col("agent_type").isNull(), "unknown").otherwise("ai").alias("kind")).agg(F.count("*").alias("visits"))


def agg01_log_stats(spark, sf):
    return L.log_stats(misses(spark, sf))


def agg01_log_stats_by_agent(spark, sf):
    return misses(spark, sf).groupBy("agent_type").agg(F.count("*").alias("n"))


def agg02_most_common_misses(spark, sf):
    return L.most_common(misses(spark, sf), "path", "us", "id", 20)


def agg03_traffic_summary(spark, sf):
    return L.zero_filled(visits(spark, sf).where("agent_type is not null"), "agent_type", [*W.AGENT_TYPES, "Unseen-Bot"], "visits")


def agg04_redirect_stats(spark, sf):
    return L.redirect_stats(visits(spark, sf))


def agg05_top_agent_paths(spark, sf):
    return L.top_agent_paths(visits(spark, sf), 15)


def agg06_alias_usage(spark, sf):
    """Aliases with the number of requests of their path after they were learned."""
    from tidewright.plans.routing import aliases

    a = aliases(spark, sf)
    used = misses(spark, sf).select(F.col("path").alias("from_path"), "id").join(a, "from_path").where("id > learned_at")
    hits = used.groupBy("from_path").agg(F.count("*").alias("hits"), F.max("id").alias("last_used"))
    return a.join(hits, "from_path", "left").select("from_path", "to_path", F.coalesce("hits", F.lit(0)).alias("hits"), "last_used")


def agg10_route_health(spark, sf):
    return L.route_health(misses(spark, sf))


def agg11_ai_traffic(spark, sf):
    v = visits(spark, sf)
    return v.agg(F.count("*").alias("total"), L.count_if(F.col("agent_type").isNotNull() & (F.col("agent_type") != "Human")).alias("ai"))


def agg13_latency(spark, sf):
    return R.latency_percentile(visits(spark, sf), "ms", "id", 0.99, 1000)


def agg14_latency_by_event(spark, sf):
    """Of the last 100 measurements of each event: mean, range and the value at floor(0.95 n)."""
    w = Window.partitionBy("event_name").orderBy(F.desc("id"))
    last = visits(spark, sf).where("ms is not null").withColumn("k", F.row_number().over(w)).where("k <= 100")
    v = F.array_sort(F.collect_list("ms"))
    return last.groupBy("event_name").agg(F.count("*").alias("n"), js_round(F.avg("ms"), 4).alias("average"), F.min("ms").alias("least"), F.max("ms").alias("most"),
                                          F.element_at(v, (F.least(F.floor(F.size(v) * 0.95), F.size(v) - 1) + 1).cast("int")).alias("p95"))


def agg15_event_stats(spark, sf):
    return visits(spark, sf).groupBy("event_name").agg(F.count("*").alias("n"), F.max("us").alias("last_us"))


def agg16_webhook_stats(spark, sf):
    kind = F.concat(F.lit("content."), changefeed.change_kind(F.col("event")))
    return read(spark, sf, "cms_events").groupBy("platform", kind.alias("event")).agg(F.count("*").alias("n"))


def agg16_webhook_pivot(spark, sf):
    kinds = ["created", "updated", "published", "unpublished", "deleted"]
    rows = read(spark, sf, "cms_events").select("platform", changefeed.change_kind(F.col("event")).alias("kind"))
    return rows.groupBy("platform").pivot("kind", kinds).count().fillna(0, kinds)


def agg18_overall_status(spark, sf):
    """Per client: unhealthy if every event is slow, degraded if any is, else healthy."""
    v = visits(spark, sf).where("client_id is not null and ms is not null")
    slow = L.count_if(F.col("ms") > 60)
    status = F.when(slow == F.count("*"), "unhealthy").when(slow > 0, "degraded").otherwise("healthy")
    return v.groupBy("client_id").agg(status.alias("status"))


def win06_recent_misses(spark, sf):
    return misses(spark, sf).orderBy(F.desc("id")).limit(10).select("id", "path", "outcome")


def win13_bounded_history(spark, sf):
    w = Window.partitionBy("path").orderBy(F.desc("us"), F.desc("id"))
    return misses(spark, sf).where("us is not null").withColumn("k", F.row_number().over(w)).where("k <= 3").select("path", "id", "k")


def win14_numbered_batches(spark, sf):
    return L.numbered_batches(visits(spark, sf).select("id"), "id", 25)


def stm01_rapid_requests(spark, sf):
    v = visits(spark, sf).where("client_id is not null and us is not null")
    return L.rapid_requests(v, "client_id", "us", 60_000_000, 5).select("id", "recent", "rapid")


def stm02_session_buckets(spark, sf):
    return L.session_buckets(visits(spark, sf).where("us is not null"), "us", "agent_type")


# ---------------------------------------------------------------- citations
def cites(spark, sf):
    return read(spark, sf, "discovered_citations")


def flt05_citation_filters(spark, sf):
    c = cites(spark, sf)
    return c.where((micros(F.col("discovered_at")) >= 1578787200000000) & F.lower("source_domain").contains("press") & F.col("is_earned_media")).select("citation_id", "source_domain")


def flt09_earned_media(spark, sf):
    return cites(spark, sf).select("citation_id", C.is_earned(F.col("source_domain"), ["dunmill.example", "Press"]).alias("earned"))


def agg07_citation_stats(spark, sf):
    return C.store_stats(cites(spark, sf))


def agg08_citation_authority(spark, sf):
    return C.citation_authority(cites(spark, sf))


def agg09_geo_score(spark, sf):
    """Per site of the citations: mean of authority, earned share, positive share and count share."""
    g = cites(spark, sf).groupBy("source_domain").agg(F.coalesce(F.avg("domain_authority"), F.lit(0.0)).alias("a"), (F.avg(F.col("is_earned_media").cast("int")) * 100).alias("e"),
        (F.avg((F.coalesce("sentiment", F.lit("")) == "positive").cast("int")) * 100).alias("p"), F.least(F.count("*"), F.lit(100)).alias("n"))
    return g.select("source_domain", C.geo_score({k: F.col(k) for k in "aepn"}).alias("score"))


def agg20_node_authority(spark, sf):
    """Sources and the kinds they mention as a graph: a kind's authority comes from the domains that cite it."""
    c = cites(spark, sf).where("source_domain is not null")
    domains = c.groupBy(F.col("source_domain").alias("id")).agg(F.max(F.coalesce("domain_authority", F.lit(0))).alias("authority"))
    kinds = c.select(F.col("source_kind").alias("id")).distinct().withColumn("authority", F.lit(50))
    edges = c.groupBy(F.col("source_domain").alias("source"), F.col("source_kind").alias("target")).agg(F.least(F.count("*") / 10, F.lit(1.0)).alias("weight"))
    return C.node_authority(domains.unionByName(kinds), edges)


def win04_sorted_citations(spark, sf):
    w = Window.partitionBy("source_kind").orderBy(F.desc_nulls_last("domain_authority"), F.desc("discovered_at"), "citation_id")
    return cites(spark, sf).withColumn("place", F.row_number().over(w)).select("source_kind", "citation_id", "place")


def jn11_domain_authority(spark, sf):
    d = cites(spark, sf).select(F.coalesce("source_domain", F.lit("x.com")).alias("domain")).distinct()
    more = spark.createDataFrame([(x,) for x in ("netflix.com", "www.github.com", "irs.gov", "mit.edu", "apache.org", "blog.medium.com", "unknown.example")], "domain string")
    return d.unionByName(more).select("domain", C.domain_authority(F.col("domain")).alias("authority"))


def jn16_first_by_url(spark, sf):
    c = cites(spark, sf).where("source_url is not null").select("citation_id", "source_url", "source_kind")
    return C.keep_first(c, ["source_url"], "citation_id")


def src12_reddit_authority(spark, sf):
    return read(spark, sf, "reddit_posts").select("post_id", "score", "num_comments", C.reddit_authority(F.col("score"), F.col("num_comments"), F.col("subreddit")).alias("authority"))


def src12_hackernews_authority(spark, sf):
    c = cites(spark, sf).where("source_kind = 'hackernews'")
    p = F.coalesce(F.try_element_at("metadata", F.lit("points")).cast("long"), F.lit(0))
    n = F.coalesce(F.try_element_at("metadata", F.lit("numComments")).cast("long"), F.lit(0))
    return c.select("citation_id", C.hackernews_authority(p, n).alias("authority"))


def src12_github_authority(spark, sf):
    p = read(spark, sf, "reddit_posts")
    return p.select("post_id", "score", "num_comments", C.github_authority(F.col("score"), F.col("num_comments")).alias("authority"))


def src13_subreddit_bonus(spark, sf):
    table = F.create_map(*[F.lit(x) for kv in W.SUBREDDIT_BONUS for x in kv])
    return read(spark, sf, "reddit_posts").select("subreddit").distinct().select("subreddit", F.coalesce(F.try_element_at(table, F.lower("subreddit")), F.lit(W.SUBREDDIT_DEFAULT)).alias("bonus"))


def cit01_standard_citations(spark, sf):
    d = url_domain(F.col("source_url"))
    return cites(spark, sf).select("citation_id", d.alias("domain"), C.domain_authority(d).alias("authority"), C.is_earned(d, ["dunmill.example"]).alias("earned"))


def sen01_sentiment(spark, sf):
    return spread(cites(spark, sf)).select("citation_id", C.sentiment(F.col("mention_context")).alias("sentiment"))


def requests(spark, sf):
    """delivery_id, client, time in microseconds, user agent, accepted types and client hints: made of the recorded agent types, as the deliveries have no headers."""
    d, nth = read(spark, sf, "geo_events"), lambda n: F.pmod("delivery_id", F.lit(n)) == 0
    ua = F.concat_ws(" ", F.when(~nth(3), "Mozilla/5.0"), F.when(~nth(2), F.col("agent_type")), F.when(nth(5), "bingbot/2.0"), F.when(nth(7), "my-crawler"))
    accept = F.when(nth(4), "application/json").when(nth(11), "text/html,application/ld+json")
    return d.select("delivery_id", F.lower(F.trim("client_id")).alias("client"), F.unix_micros("event_ts").alias("us"), ua.alias("ua"), accept.alias("accept"), F.when(nth(9), '"Browser"').alias("hints"))


def cls01_detected_agents(spark, sf):
    a = L.agent_of_request(F.col("ua"), F.col("accept"))
    return requests(spark, sf).select("delivery_id", a["type"].alias("detected"), a["confidence"].alias("confidence"), a["signal"].alias("signal"))


def cls02_behavior(spark, sf):
    """Signs of behavior, with the client's requests of the last five seconds."""
    r = L.rapid_requests(requests(spark, sf).where("us is not null"), "client", "us", 5_000_000, 5)
    return r.select("delivery_id", L.behavior(F.col("ua"), F.col("accept"), F.col("hints"), F.col("recent")).alias("b")).select("delivery_id", "b.*")


def cls03_judged_agents(spark, sf):
    r = L.rapid_requests(requests(spark, sf).where("us is not null"), "client", "us", 5_000_000, 5)
    j = L.judged_agent(L.agent_of_request(F.col("ua"), F.col("accept")), L.behavior(F.col("ua"), F.col("accept"), F.col("hints"), F.col("recent")))
    return r.select("delivery_id", j.alias("j")).select("delivery_id", "j.type", "j.confidence", F.array_join("j.signals", "; ").alias("signals"), "j.rendering")


# ---------------------------------------------------------------- freshness
def updates(spark, sf):
    return read(spark, sf, "cms_events").select("path", "last_modified")


def pages(spark, sf):
    return updates(spark, sf).where("path is not null").groupBy("path").agg(F.max("last_modified").alias("last_modified"))


def _now():
    return F.lit(NOW).cast("timestamp")


def dt01_age_in_days(spark, sf):
    return pages(spark, sf).select("path", FR.age_in_days(F.col("last_modified"), _now()).alias("age_days"))


def dt03_freshness(spark, sf):
    return FR.freshness(pages(spark, sf), _now(), 40).select("path", "age_days", "is_stale", "refresh_priority")


def dt04_velocity(spark, sf):
    return FR.velocity(updates(spark, sf))


def dt05_velocity_in_window(spark, sf):
    return FR.velocity(updates(spark, sf).where(F.col("last_modified") >= F.add_months(F.lit("2020-02-20").cast("date"), -1).cast("timestamp")))


def win05_stale_pages(spark, sf):
    f = FR.freshness(pages(spark, sf), _now(), 40).where("is_stale")
    return f.orderBy(F.desc("age_days"), "path").select("path", "age_days")


def dt06_session_ids(spark, sf):
    v = visits(spark, sf).where("us is not null")
    return v.select("id", F.concat_ws("_", F.coalesce("agent_type", F.lit("Human")), F.floor(F.col("us") / 300_000_000).cast("string")).alias("session"))


# ---------------------------------------------------------------- SQL twins
_M = """m AS (SELECT delivery_id AS id, route_details.requested_path AS path, CASE WHEN route_details.match_method = 'alias' THEN 'alias-used'
    WHEN route_details.match_method IN ('exact', 'semantic') THEN 'redirected' ELSE '404' END AS outcome, coalesce(route_details.confidence, 0.0) AS confidence,
    coalesce(geo_metrics.processing_time_ms, 0.0) AS latency_ms, coalesce(agent_type, 'Human') AS agent_type, epoch_us(event_ts) AS us
    FROM geo_events WHERE route_details.requested_path IS NOT NULL)"""
_V = """v AS (SELECT delivery_id AS id, page_location AS path, agent_type, client_id, epoch_us(event_ts) AS us, route_details.match_method IN ('alias', 'semantic') AS was_redirected,
    event_name, geo_metrics.processing_time_ms AS ms FROM geo_events)"""
_R2 = "floor({0} * 100 + 0.5) / 100"
_R4 = "floor({0} * 10000 + 0.5) / 10000"
_AGENTS = "(VALUES " + ", ".join(f"('{a}')" for a in W.AGENT_TYPES) + ") AS d(agent_type)"
_E = "lower(trim(event))"
_KIND = f"""CASE WHEN regexp_matches({_E}, '(unpublish|trash)(ed)?$') THEN 'unpublished' WHEN regexp_matches({_E}, 'publish(ed)?$') THEN 'published'
    WHEN regexp_matches({_E}, 'deleted?$') THEN 'deleted' WHEN regexp_matches({_E}, 'created?$') THEN 'created' ELSE 'updated' END"""
_AUTH = "CASE " + " ".join(f"WHEN regexp_replace(lower({{0}}), '^www\\.', '') = '{d}' OR {{0}} = '{d}' THEN {s}" for d, s in W.DOMAIN_AUTHORITY) + " " + " ".join(
    f"WHEN contains(lower({{0}}), '{d}') THEN {s}" for d, s in W.DOMAIN_AUTHORITY) + " WHEN {0} LIKE '%.gov' THEN 85 WHEN {0} LIKE '%.edu' THEN 80 WHEN {0} LIKE '%.org' THEN 50 WHEN {0} IS NULL THEN NULL ELSE 30 END"
_BONUS = "CASE lower(subreddit) " + " ".join(f"WHEN '{d}' THEN {s}" for d, s in W.SUBREDDIT_BONUS) + f" ELSE {W.SUBREDDIT_DEFAULT} END"
_DOM = r"regexp_replace(regexp_extract(lower(source_url), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)', 1), '^www\.', '')"
_PAGES = "pages AS (SELECT path, max(last_modified) AS lm FROM cms_events WHERE path IS NOT NULL GROUP BY path)"
_AGE = f"(epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(lm)) // 86400000000"
_VEL = """SELECT path, count(*) AS updates, CASE WHEN count(*) > 1 AND max(us) > min(us) THEN floor((count(*) - 1) / ((max(us) - min(us)) / 2592000000000.0::DOUBLE) * 100 + 0.5) / 100 ELSE 0.0 END AS velocity
    FROM (SELECT path, epoch_us(last_modified) AS us FROM cms_events WHERE path IS NOT NULL AND last_modified IS NOT NULL {0}) GROUP BY path"""
_UA = "concat_ws(' ', 'Mozilla/5.0', agent_type, CASE WHEN delivery_id % 5 = 0 THEN 'bingbot/2.0' END, CASE WHEN delivery_id % 7 = 0 THEN 'my-crawler' END)"
_DET = "CASE " + " ".join(f"WHEN regexp_matches({_UA}, '{'|'.join(p)}', 'i') THEN '{k}'" for k, p in W.AGENT_PATTERNS) + " ELSE 'Human' END"

from tidewright.plans.routing import _ALIAS  # noqa: E402

_SIGNED = "CASE " + " ".join(f"WHEN regexp_matches(ua, '(?i){p}') THEN {{'t': '{k}', 'c': 0.9, 's': 'User-Agent matches: {p}'}}" for k, ps in W.AGENT_PATTERNS for p in ps)
_REQ = f"""q AS (SELECT delivery_id, lower(trim(client_id)) AS client, epoch_us(event_ts) AS us, concat_ws(' ', CASE WHEN delivery_id % 3 <> 0 THEN 'Mozilla/5.0' END, CASE WHEN delivery_id % 2 <> 0 THEN agent_type END,
        CASE WHEN delivery_id % 5 = 0 THEN 'bingbot/2.0' END, CASE WHEN delivery_id % 7 = 0 THEN 'my-crawler' END) AS ua, CASE WHEN delivery_id % 4 = 0 THEN 'application/json' WHEN delivery_id % 11 = 0 THEN 'text/html,application/ld+json' ELSE '' END AS accept,
        delivery_id % 9 = 0 AS hints FROM geo_events),
    g AS (SELECT *, {_SIGNED} WHEN contains(accept, 'application/json') AND NOT contains(ua, 'Mozilla') THEN {{'t': 'Generic-Bot', 'c': 0.6, 's': 'Prefers JSON, no browser signature'}} ELSE {{'t': 'Human', 'c': 0.8, 's': 'No bot signatures detected'}} END AS a,
        contains(accept, 'json') AS j, NOT regexp_matches(ua, 'Mozilla|Chrome|Safari') AND NOT hints AS n,
        CASE WHEN us IS NULL THEN false ELSE count(us) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN 4999999 PRECEDING AND CURRENT ROW) >= 5 END AS r FROM q)"""
ORACLES = {
    "flt02_misses_in_range": f"WITH {_M} SELECT id, path, us FROM m WHERE outcome = '404' AND agent_type = 'ChatGPT' AND us BETWEEN 1578787200000000 AND 1579392000000000",
    "flt03_agent_traffic": f"WITH {_V} SELECT CASE WHEN agent_type = 'Human' THEN 'human' WHEN agent_type IS NULL THEN 'unknown' ELSE 'ai' END AS kind, count(*) AS visits FROM v WHERE us BETWEEN 1578787200000000 AND 1579392000000000 GROUP BY 1",
    "agg01_log_stats": f"""WITH {_M} SELECT count(*) AS total, count(*) FILTER (outcome = 'redirected') AS redirected, count(*) FILTER (outcome = '404') AS not_found, count(*) FILTER (outcome = 'alias-used') AS alias_used,
        round(coalesce(avg(confidence), 0), 6) AS avg_confidence, round(coalesce(avg(latency_ms), 0), 6) AS avg_latency FROM m""",
    "agg01_log_stats_by_agent": f"WITH {_M} SELECT agent_type, count(*) AS n FROM m GROUP BY 1",
    "agg02_most_common_misses": f"WITH {_M} SELECT path, n, last_seen FROM (SELECT path, count(*) AS n, max(us) AS last_seen, min(id) AS f FROM m GROUP BY path) ORDER BY n DESC, f LIMIT 20",
    "agg03_traffic_summary": f"WITH {_V} SELECT d.agent_type, count(v.id) AS visits FROM (SELECT * FROM {_AGENTS} UNION ALL SELECT 'Unseen-Bot') d LEFT JOIN v ON v.agent_type = d.agent_type GROUP BY 1",
    "agg04_redirect_stats": f"""WITH {_V} SELECT d.agent_type, count(v.id) AS visits, count(*) FILTER (was_redirected) AS redirects,
        round(coalesce(count(*) FILTER (was_redirected) / nullif(count(v.id), 0)::DOUBLE, 0.0), 6) AS rate FROM {_AGENTS} LEFT JOIN v ON v.agent_type = d.agent_type GROUP BY 1""",
    "agg05_top_agent_paths": f"WITH {_V} SELECT path, count(*) AS visits, string_agg(DISTINCT agent_type, ',' ORDER BY agent_type) AS agents FROM v WHERE agent_type <> 'Human' GROUP BY path ORDER BY visits DESC, path LIMIT 15",
    "agg06_alias_usage": f"WITH {_M}, {_ALIAS} SELECT from_path, to_path, count(id) AS hits, max(id) AS last_used FROM al LEFT JOIN m ON path = from_path AND id > learned_at GROUP BY 1, 2",
    "agg10_route_health": f"""WITH {_M}, s AS (SELECT count(*) AS total, count(*) FILTER (outcome IN ('redirected', 'alias-used')) AS redirects,
        coalesce({_R2.format('avg(confidence) FILTER (confidence > 0)')}, 0.0) AS avg_confidence FROM m)
        SELECT *, CASE WHEN total = 0 THEN 100 ELSE least(floor(redirects / total::DOUBLE * 80 + avg_confidence * 20 + 0.5), 100) END::BIGINT AS score FROM s""",
    "agg11_ai_traffic": f"WITH {_V} SELECT count(*) AS total, count(*) FILTER (agent_type <> 'Human') AS ai FROM v",
    "agg13_latency": f"""WITH {_V}, l AS (SELECT ms FROM (SELECT ms, row_number() OVER (ORDER BY id DESC) AS k FROM v WHERE ms IS NOT NULL) WHERE k <= 1000), s AS (SELECT count(*) AS n, {_R4.format('avg(ms)')} AS average, min(ms) AS least, max(ms) AS most, list_sort(list(ms)) AS x FROM l)
        SELECT n, average, least, most, x[least(floor(n * 0.99), n - 1)::INT + 1] AS percentile FROM s""",
    "agg14_latency_by_event": f"""WITH {_V}, k AS (SELECT *, row_number() OVER (PARTITION BY event_name ORDER BY id DESC) AS k FROM v WHERE ms IS NOT NULL),
        s AS (SELECT event_name, count(*) AS n, {_R4.format('avg(ms)')} AS average, min(ms) AS least, max(ms) AS most, list_sort(list(ms)) AS x FROM k WHERE k <= 100 GROUP BY 1)
        SELECT event_name, n, average, least, most, x[least(floor(n * 0.95), n - 1)::INT + 1] AS p95 FROM s""",
    "agg15_event_stats": f"WITH {_V} SELECT event_name, count(*) AS n, max(us) AS last_us FROM v GROUP BY 1",
    "agg16_webhook_stats": f"SELECT platform, 'content.' || {_KIND} AS event, count(*) AS n FROM cms_events GROUP BY 1, 2",
    "agg16_webhook_pivot": "SELECT platform, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("created", "updated", "published", "unpublished", "deleted")) + f" FROM (SELECT platform, {_KIND} AS kind FROM cms_events) GROUP BY 1",
    "agg18_overall_status": f"""WITH {_V} SELECT client_id, CASE WHEN count(*) FILTER (ms > 60) = count(*) THEN 'unhealthy' WHEN count(*) FILTER (ms > 60) > 0 THEN 'degraded' ELSE 'healthy' END AS status
        FROM v WHERE client_id IS NOT NULL AND ms IS NOT NULL GROUP BY 1""",
    "win06_recent_misses": f"WITH {_M} SELECT id, path, outcome FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS k FROM m) WHERE k <= 10",
    "win13_bounded_history": f"WITH {_M} SELECT path, id, k FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY us DESC, id DESC) AS k FROM m WHERE us IS NOT NULL) WHERE k <= 3",
    "win14_numbered_batches": "SELECT delivery_id AS id, (row_number() OVER (ORDER BY delivery_id) - 1) // 25 AS batch FROM geo_events",
    "stm01_rapid_requests": f"""WITH {_V} SELECT id, recent, recent >= 5 AS rapid FROM (SELECT id, count(*) OVER (PARTITION BY client_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent
        FROM v WHERE client_id IS NOT NULL AND us IS NOT NULL)""",
    "stm02_session_buckets": f"WITH {_V} SELECT agent_type, us // 300000000 AS bucket, count(*) AS events FROM v WHERE us IS NOT NULL GROUP BY 1, 2",
    "flt05_citation_filters": "SELECT citation_id, source_domain FROM discovered_citations WHERE epoch_us(discovered_at) >= 1578787200000000 AND contains(lower(source_domain), 'press') AND is_earned_media",
    "flt09_earned_media": "SELECT citation_id, NOT (contains(lower(source_domain), 'dunmill.example') OR contains(lower(source_domain), 'press')) AS earned FROM discovered_citations",
    "agg07_citation_stats": """SELECT count(*) AS total, count(*) FILTER (is_earned_media) AS earned, count(*) FILTER (NOT is_earned_media) AS owned, count(*) FILTER (sentiment = 'positive') AS positive,
        count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative, coalesce(floor(avg(domain_authority) + 0.5), 0)::BIGINT AS avg_authority FROM discovered_citations""",
    "agg08_citation_authority": """SELECT least(floor(coalesce(sum(coalesce(domain_authority, 0) * w * m) / sum(w), 0) + 0.5), 100)::BIGINT AS authority FROM (SELECT domain_authority,
        CASE WHEN is_earned_media THEN 1.5 ELSE 1.0 END::DOUBLE AS w, CASE sentiment WHEN 'positive' THEN 1.2 WHEN 'negative' THEN 0.5 ELSE 1.0 END::DOUBLE AS m FROM discovered_citations)""",
    "agg09_geo_score": """SELECT source_domain, floor((coalesce(avg(domain_authority), 0) + avg(is_earned_media::INT) * 100 + avg((coalesce(sentiment, '') = 'positive')::INT) * 100 + least(count(*), 100)) / 4 + 0.5)::BIGINT AS score
        FROM discovered_citations GROUP BY 1""",
    "agg20_node_authority": """WITH c AS (SELECT * FROM discovered_citations WHERE source_domain IS NOT NULL),
        nodes AS (SELECT source_domain AS id, max(coalesce(domain_authority, 0)) AS authority FROM c GROUP BY 1 UNION ALL SELECT DISTINCT source_kind, 50 FROM c),
        e AS (SELECT source_domain AS source, source_kind AS target, least(count(*) / 10.0::DOUBLE, 1.0) AS weight FROM c GROUP BY 1, 2),
        i AS (SELECT target, floor(avg(coalesce(n.authority, 0) * weight) + 0.5) AS mean FROM e LEFT JOIN nodes n ON n.id = e.source GROUP BY 1)
        SELECT id, coalesce(least(mean, 100), authority)::BIGINT AS authority FROM nodes LEFT JOIN i ON id = target""",
    "win04_sorted_citations": "SELECT source_kind, citation_id, row_number() OVER (PARTITION BY source_kind ORDER BY domain_authority DESC NULLS LAST, discovered_at DESC NULLS LAST, citation_id) AS place FROM discovered_citations",
    "jn11_domain_authority": f"""SELECT domain, {_AUTH.replace('{0}', 'domain')} AS authority FROM (SELECT DISTINCT coalesce(source_domain, 'x.com') AS domain FROM discovered_citations
        UNION ALL SELECT * FROM (VALUES ('netflix.com'), ('www.github.com'), ('irs.gov'), ('mit.edu'), ('apache.org'), ('blog.medium.com'), ('unknown.example')) AS t(d))""",
    "jn16_first_by_url": "SELECT citation_id, source_url, source_kind FROM discovered_citations WHERE source_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY citation_id) = 1",
    "src12_reddit_authority": f"SELECT post_id, score, num_comments, least(100, floor(30 + 10 * log10(greatest(1, score + 2 * num_comments)) + {_BONUS} + 0.5))::BIGINT AS authority FROM reddit_posts",
    "src12_hackernews_authority": "SELECT citation_id, least(100, floor(60 + 15 * log10(greatest(1, coalesce(metadata['points']::BIGINT, 0) + 3 * coalesce(metadata['numComments']::BIGINT, 0))) + 0.5))::BIGINT AS authority FROM discovered_citations WHERE source_kind = 'hackernews'",
    "src12_github_authority": "SELECT post_id, score, num_comments, least(100, floor(50 + 10 * log10(greatest(1, score)) + 5 * log10(greatest(1, num_comments)) + 0.5))::BIGINT AS authority FROM reddit_posts",
    "src13_subreddit_bonus": f"SELECT DISTINCT subreddit, {_BONUS} AS bonus FROM reddit_posts",
    "cit01_standard_citations": f"SELECT citation_id, domain, {_AUTH.replace('{0}', 'domain')} AS authority, NOT contains(domain, 'dunmill.example') AS earned FROM (SELECT citation_id, {_DOM} AS domain FROM discovered_citations)",
    "cls01_detected_agents": f"WITH {_REQ} SELECT delivery_id, a.t AS detected, a.c::DOUBLE AS confidence, a.s AS signal FROM g",
    "cls02_behavior": f"WITH {_REQ} SELECT delivery_id, j AS accepts_json, n AS no_scripts, r AS rapid FROM g WHERE us IS NOT NULL",
    "cls03_judged_agents": f"""WITH {_REQ} SELECT delivery_id, a.t AS type, CASE WHEN a.t = 'Human' THEN a.c::DOUBLE ELSE round(least(0.99, a.c + (j::INT + n::INT + r::INT) * 0.03), 6)::DOUBLE END AS confidence,
        concat_ws('; ', a.s, CASE WHEN j THEN 'Behavior: Accepts JSON' END, CASE WHEN n THEN 'Behavior: No JS execution' END, CASE WHEN r THEN 'Behavior: Rapid requests detected' END) AS signals,
        CASE WHEN a.t = 'Human' THEN 'csr' WHEN j THEN 'json' ELSE 'ssr' END AS rendering FROM g WHERE us IS NOT NULL""",
    "dt01_age_in_days": f"WITH {_PAGES} SELECT path, {_AGE} AS age_days FROM pages",
    "dt03_freshness": f"""WITH {_PAGES}, a AS (SELECT path, {_AGE} AS age_days FROM pages WHERE lm IS NOT NULL) SELECT path, age_days, age_days > 40 AS is_stale,
        CASE WHEN age_days >= 80 THEN 'critical' WHEN age_days >= 40 THEN 'high' WHEN age_days >= 20 THEN 'medium' ELSE 'low' END AS refresh_priority FROM a""",
    "dt04_velocity": _VEL.format(""),
    "dt05_velocity_in_window": _VEL.format("AND last_modified >= TIMESTAMPTZ '2020-01-20 00:00:00+00'"),
    "win05_stale_pages": f"WITH {_PAGES} SELECT path, {_AGE} AS age_days FROM pages WHERE lm IS NOT NULL AND {_AGE} > 40",
    "dt06_session_ids": f"WITH {_V} SELECT id, coalesce(agent_type, 'Human') || '_' || (us // 300000000) AS session FROM v WHERE us IS NOT NULL",
}
QUERIES = {f.__name__: f for f in (
    flt02_misses_in_range, flt03_agent_traffic, agg01_log_stats, agg01_log_stats_by_agent, agg02_most_common_misses, agg03_traffic_summary, agg04_redirect_stats, agg05_top_agent_paths,
    agg06_alias_usage, agg10_route_health, agg11_ai_traffic, agg13_latency, agg14_latency_by_event, agg15_event_stats, agg16_webhook_stats, agg16_webhook_pivot, agg18_overall_status,
    win06_recent_misses, win13_bounded_history, win14_numbered_batches, stm01_rapid_requests, stm02_session_buckets, flt05_citation_filters, flt09_earned_media, agg07_citation_stats,
    agg08_citation_authority, agg09_geo_score, agg20_node_authority, win04_sorted_citations, jn11_domain_authority, jn16_first_by_url, src12_reddit_authority, src12_hackernews_authority,
    src12_github_authority, src13_subreddit_bonus, cit01_standard_citations, sen01_sentiment, cls01_detected_agents, cls02_behavior, cls03_judged_agents, dt01_age_in_days, dt03_freshness, dt04_velocity, dt05_velocity_in_window,
    win05_stale_pages, dt06_session_ids)}
