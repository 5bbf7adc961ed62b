"""Queries of the general problems 2, 4 and 5, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.operators import changefeed, messages, sessions


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sessions_of_messages(read(spark, sf, "geo_events")).select("client_id", "start_us", "end_us")


def p2_session_table(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions.sessions_of_messages(read(spark, sf, "geo_events"))
    return s.select("client_id", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "events")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    last = changefeed.resolve_newest_first(changefeed.changes(read(spark, sf, "cms_events")))
    return last.where("kind <> 'deleted'").select("platform", "content_id", "feed_seq")


def p4_content_table(spark: SparkSession, sf: str) -> DataFrame:
    """The older half of the feed makes the base, the rest is applied to it."""
    feed = read(spark, sf, "cms_events")
    middle = F.lit("2020-01-18 00:00:00").cast("timestamp")
    old = F.coalesce("last_modified", "received_at") < middle
    base = changefeed.apply_changes(None, feed.where(old), 1)
    table = changefeed.apply_changes(base, feed.where(~F.coalesce(old, F.lit(False))), 3)
    return table.select("platform", "content_id", "feed_seq", "content_type", "path", "title", F.length("content").alias("content_chars"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return messages.repeated_deliveries(read(spark, sf, "geo_events"))


def p5_messages(spark: SparkSession, sf: str) -> DataFrame:
    store = messages.stored_messages(read(spark, sf, "geo_events"), ["event_name", "client_id"])
    return store.runs().select(F.col("_id").alias("delivery_id"), "_row.event_name", "_row.client_id")


_KEPT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('k' || lower(trim(event_id)), 'n' || delivery_id)
    ORDER BY event_ts NULLS LAST, delivery_id) AS rn FROM geo_events) WHERE rn = 1"""
_SESSIONS = f"""WITH kept AS ({_KEPT}),
e AS (SELECT lower(trim(client_id)) AS client_id, epoch_us(event_ts) AS us FROM kept WHERE trim(client_id) <> '' AND event_ts IS NOT NULL),
o AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY client_id ORDER BY us)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY client_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT client_id, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS events FROM n GROUP BY client_id, n"""
_KIND = r"""CASE WHEN regexp_matches(e, '(unpublish|trash)(ed)?$') THEN 'unpublished' WHEN regexp_matches(e, 'publish(ed)?$') THEN 'published'
    WHEN regexp_matches(e, 'deleted?$') THEN 'deleted' WHEN regexp_matches(e, 'created?$') THEN 'created' ELSE 'updated' END"""
_CONTENT = f"""WITH c AS (SELECT *, trim(content_id) AS cid, coalesce(last_modified, received_at) AS t, lower(trim(event)) AS e
    FROM cms_events WHERE trim(content_id) <> ''),
k AS (SELECT *, {_KIND} AS kind FROM c),
u AS (SELECT *, row_number() OVER (PARTITION BY platform, cid, t, kind ORDER BY feed_seq) AS copy FROM k),
l AS (SELECT *, row_number() OVER (PARTITION BY platform, cid ORDER BY t DESC, feed_seq DESC) AS back FROM u WHERE copy = 1)
SELECT platform, cid AS content_id, feed_seq, content_type, path, title, length(content) AS content_chars FROM l WHERE back = 1 AND kind <> 'deleted'"""

QUERIES = {f.__name__: f for f in (p2_found, p2_session_table, p4_found, p4_content_table, p5_found, p5_messages)}
ORACLES = {
    "p2_found": f"SELECT client_id, start_us, end_us FROM ({_SESSIONS})",
    "p2_session_table": _SESSIONS,
    "p4_found": f"SELECT platform, content_id, feed_seq FROM ({_CONTENT})",
    "p4_content_table": _CONTENT,
    "p5_found": """SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY lower(trim(event_id))
    ORDER BY event_ts NULLS LAST, delivery_id) AS rn FROM geo_events WHERE event_id IS NOT NULL) WHERE rn > 1""",
    "p5_messages": f"SELECT delivery_id, event_name, client_id FROM ({_KEPT})",
}
