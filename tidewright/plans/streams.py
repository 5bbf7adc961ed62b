"""Queries that run a stream over the tables as files and return what it wrote; their SQL twins are the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators.messages import micros
from tidewright.plans.logs import ORACLES as LOGS
from tidewright.plans.problems import read
from tidewright.plans.routing import ORACLES as ROUTING
from tidewright.plans.content import ORACLES as CONTENT
from tidewright.plans.problems import _KIND
from tidewright.streaming import receiver, stateful as ST

ALLOWED = ["contentful", "sanity", "strapi"]


def stream(spark, sf, table):
    """A table's file as a stream."""
    return spark.readStream.schema(read(spark, sf, table).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/{table}.parquet*")


def stm02_stream_buckets(spark, sf):
    rows = stream(spark, sf, "geo_events").where("event_ts is not null").select("agent_type", "event_ts")
    out = ST.run_to_table(rows.groupBy("agent_type", F.floor(micros(F.col("event_ts")) / 300_000_000).alias("bucket")).agg(F.count("*").alias("events")), "buckets", "complete")
    return out


def stm03_stream_aliases(spark, sf):
    e = stream(spark, sf, "geo_events").where("route_details.match_method = 'semantic'")
    e = e.select(F.col("route_details.requested_path").alias("from_path"), F.col("route_details.matched_path").alias("to_path"), F.col("delivery_id").alias("seq"))
    return ST.run_to_table(ST.learned_aliases(e, 3), "aliases")


def stm06_stream_velocity(spark, sf):
    from tidewright.functions.paths import js_round

    v = ST.run_to_table(ST.update_velocity(stream(spark, sf, "cms_events")), "velocity", "complete")
    months = (micros(F.col("last")) - micros(F.col("first"))) / 2_592_000_000_000.0
    return v.select("path", "updates", F.coalesce(js_round(F.when((F.col("updates") > 1) & (months > 0), F.try_divide(F.col("updates") - 1, months)), 2), F.lit(0.0)).alias("velocity"))


def stm10_stream_event_counts(spark, sf):
    rows = stream(spark, sf, "geo_events").select("event_name", micros(F.col("event_ts")).alias("us"))
    return ST.run_to_table(rows.groupBy("event_name").agg(F.count("*").alias("n"), F.max("us").alias("last_us")), "counts", "complete")


def stm01_stream_rapid(spark, sf):
    rows = stream(spark, sf, "geo_events").select("client_id", micros(F.col("event_ts")).alias("us"))
    return ST.run_to_table(ST.rapid_clients(rows, window_us=60_000_000, least=5), "rapid")


def stm08_stream_limiter(spark, sf):
    rows = stream(spark, sf, "geo_events").where("agent_type is not null and event_ts is not null").select(F.col("agent_type").alias("name"), micros(F.col("event_ts")).alias("us"))
    return ST.run_to_table(ST.token_bucket(rows, 10, 5, 3_600_000_000), "limiter").groupBy("name").agg(F.count("*").alias("requests"), F.sum(F.col("granted").cast("int")).alias("granted"))


def stm09_stream_breaker(spark, sf):
    rows = stream(spark, sf, "geo_events").where("agent_type is not null and event_ts is not null").select(
        F.col("agent_type").alias("name"), micros(F.col("event_ts")).alias("us"), (F.coalesce("geo_metrics.processing_time_ms", F.lit(0.0)) < 70).alias("ok"))
    return ST.run_to_table(ST.circuit_breaker(rows, 3, 3_600_000_000, 2), "breaker").groupBy("name", "state").agg(F.count("*").alias("calls"))


def stm07_receiver(spark, sf):
    """Changes of the allowed platforms, taken in as they come: what is kept of each, with the density of its content."""
    out = receiver.received(stream(spark, sf, "cms_events"), ALLOWED)
    return ST.run_to_table(out, "received").select("feed_seq", "platform", "content_id", "kind", "us", "score")


def stm07_receiver_counts(spark, sf):
    return ST.run_to_table(receiver.counters(stream(spark, sf, "cms_events"), ALLOWED), "counters", "complete")


QUERIES = {f.__name__: f for f in (stm07_receiver, stm07_receiver_counts, stm02_stream_buckets, stm03_stream_aliases, stm06_stream_velocity, stm10_stream_event_counts, stm01_stream_rapid, stm08_stream_limiter, stm09_stream_breaker)}
_IN = ", ".join(f"'{p}'" for p in ALLOWED)
_NUMBERED = """n AS (SELECT agent_type AS name, epoch_us(event_ts) AS us, coalesce(geo_metrics.processing_time_ms, 0.0) < 70 AS ok,
    row_number() OVER (PARTITION BY agent_type ORDER BY event_ts, coalesce(geo_metrics.processing_time_ms, 0.0) < 70) AS k FROM geo_events WHERE agent_type IS NOT NULL AND event_ts IS NOT NULL)"""
_STEPS = "greatest(0, (n.us - r.last) // 3600000000)"
_MODE = "CASE WHEN r.mode = 'open' AND n.us - r.since >= 3600000000 THEN 'half-open' ELSE r.mode END"
_PASSED = f"CASE WHEN r.mode = 'open' AND {_MODE} = 'half-open' THEN 0 ELSE r.passed END"
ORACLES = {
    "stm07_receiver": f"""WITH den AS ({CONTENT['txt09_density'].replace('FROM documents', "FROM (SELECT feed_seq AS doc_id, content AS text FROM cms_events)")})
        SELECT feed_seq, platform, trim(content_id) AS content_id, kind, epoch_us(coalesce(last_modified, received_at)) AS us, score FROM (SELECT *, {_KIND} AS kind FROM (SELECT *, lower(trim(event)) AS e FROM cms_events)) JOIN den ON doc_id = feed_seq
        WHERE platform IN ({_IN}) AND trim(content_id) <> ''""",
    "stm07_receiver_counts": f"SELECT platform, count(*) AS received, sum((platform IN ({_IN}))::INT)::BIGINT AS allowed, coalesce(sum((platform IN ({_IN}) AND trim(content_id) <> '')::INT), 0)::BIGINT AS processed, epoch_us(max(received_at)) AS last_us FROM cms_events GROUP BY 1",
    "stm08_stream_limiter": f"""WITH RECURSIVE {_NUMBERED}, r AS (SELECT name, k, us AS last, 9::BIGINT AS tokens, true AS granted FROM n WHERE k = 1 UNION ALL
        SELECT name, k, last, (t - (t > 0)::INT)::BIGINT, t > 0 FROM (SELECT n.name, n.k, r.last + {_STEPS} * 3600000000 AS last, least(10, r.tokens + {_STEPS} * 5) AS t FROM r JOIN n ON n.name = r.name AND n.k = r.k + 1))
        SELECT name, count(*) AS requests, sum(granted::INT)::BIGINT AS granted FROM r GROUP BY 1""",
    "stm09_stream_breaker": f"""WITH RECURSIVE {_NUMBERED}, r AS (SELECT name, 0::BIGINT AS k, 'closed' AS mode, 0 AS failed, 0 AS passed, 0::BIGINT AS since FROM (SELECT DISTINCT name FROM n) UNION ALL
        SELECT name, k, CASE WHEN m = 'open' THEN m WHEN ok AND m = 'half-open' AND p + 1 >= 2 THEN 'closed' WHEN NOT ok AND (m = 'half-open' OR failed + 1 >= 3) THEN 'open' ELSE m END,
        CASE WHEN m = 'open' THEN failed WHEN ok OR m = 'half-open' OR failed + 1 >= 3 THEN 0 ELSE failed + 1 END, CASE WHEN m = 'half-open' AND ok THEN p + 1 ELSE p END, CASE WHEN m <> 'open' AND NOT ok AND (m = 'half-open' OR failed + 1 >= 3) THEN us ELSE since END
        FROM (SELECT n.name, n.k, n.us, n.ok, {_MODE} AS m, {_PASSED} AS p, r.failed, r.since FROM r JOIN n ON n.name = r.name AND n.k = r.k + 1))
        SELECT name, mode AS state, count(*) AS calls FROM r WHERE k > 0 GROUP BY 1, 2""",
    "stm02_stream_buckets": LOGS["stm02_session_buckets"],
    "stm03_stream_aliases": ROUTING["stm03_learned_aliases"],
    "stm06_stream_velocity": LOGS["dt04_velocity"],
    "stm10_stream_event_counts": LOGS["agg15_event_stats"],
    "stm01_stream_rapid": "WITH v AS (SELECT client_id, epoch_us(event_ts) AS us, delivery_id FROM geo_events WHERE client_id IS NOT NULL AND event_ts IS NOT NULL), w AS (SELECT client_id, us, row_number() OVER (PARTITION BY client_id ORDER BY us, delivery_id) AS n FROM v) SELECT a.client_id, a.us, count(*) AS recent FROM w a JOIN w b ON a.client_id = b.client_id AND b.n <= a.n AND a.us - b.us < 60000000 GROUP BY a.client_id, a.us, a.n HAVING count(*) >= 5",
}
