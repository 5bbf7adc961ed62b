"""Aggregates over request and traffic logs. Every one combines before the shuffle; fixed domains are filled with zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.functions.paths import js_round
from tidewright.functions.structure import regex
from tidewright.lexicons.words import AGENT_PATTERNS, AGENT_TYPES


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def zero_filled(rows: DataFrame, key: str, domain: Sequence[str], name: str = "n") -> DataFrame:
    """A count for each value of a fixed domain, also where there is none."""
    spark = rows.sparkSession
    all_values = spark.createDataFrame([(v,) for v in domain], f"{key} string")
    counts = rows.groupBy(key).agg(F.count("*").alias(name))
    return all_values.join(counts, key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def log_stats(rows: DataFrame) -> DataFrame:
    """total, redirected, not_found, alias_used, mean confidence and latency (0 when empty). rows: outcome, confidence, latency_ms."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return rows.agg(
        F.count("*").alias("total"), count_if(F.col("outcome") == "redirected").alias("redirected"), count_if(F.col("outcome") == "404").alias("not_found"),
        count_if(F.col("outcome") == "alias-used").alias("alias_used"), mean("confidence").alias("avg_confidence"), mean("latency_ms").alias("avg_latency"))


def most_common(rows: DataFrame, path: str, ts: str, order: str, k: int) -> DataFrame:
    """The k paths with most rows, their count and last time; ties go to the path seen first."""
    g = rows.groupBy(F.col(path).alias("path")).agg(F.count("*").alias("n"), F.max(ts).alias("last_seen"), F.min(order).alias("_first"))
    return g.orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def top_agent_paths(rows: DataFrame, k: int) -> DataFrame:
    """Of the automated agents: paths by visits, with the distinct agents that came. rows: path, agent_type."""
    g = rows.where("agent_type is not null and agent_type <> 'Human'").groupBy("path").agg(
        F.count("*").alias("visits"), F.array_join(F.array_sort(F.collect_set("agent_type")), ",").alias("agents"))
    return g.orderBy(F.desc("visits"), "path").limit(k)


def redirect_stats(rows: DataFrame) -> DataFrame:
    """Per agent of the fixed domain: visits, redirects and their rate. rows: agent_type, was_redirected."""
    g = rows.groupBy("agent_type").agg(F.count("*").alias("visits"), count_if(F.col("was_redirected")).alias("redirects"))
    domain = rows.sparkSession.createDataFrame([(a,) for a in AGENT_TYPES], "agent_type string")
    out = domain.join(g, "agent_type", "left").fillna(0, ["visits", "redirects"])
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("redirects").cast("double"), F.col("visits")), F.lit(0.0)), 6))


def route_health(rows: DataFrame) -> DataFrame:
    """redirects (redirected or alias used), mean confidence of rows above 0 in two digits, score (100 if empty)."""
    hit = F.col("outcome").isin("redirected", "alias-used")
    out = rows.agg(F.count("*").alias("total"), count_if(hit).alias("redirects"),
                   F.coalesce(js_round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 2), F.lit(0.0)).alias("avg_confidence"))
    score = F.least(js_round(F.try_divide(F.col("redirects").cast("double"), F.col("total")) * 80 + F.col("avg_confidence") * 20), F.lit(100))
    return out.withColumn("score", F.when(F.col("total") == 0, 100).otherwise(score))


def rapid_requests(rows: DataFrame, client: str, us: str, window_us: int, least: int) -> DataFrame:
    """Each row with the number of the client's rows in the `window_us` up to it, itself included, and whether that is rapid.

    A client's time is cut into stretches, so one that sends a third of all rows is no single task; a row that later stretches look back on is handed
    to the next one, too, as a stretch is longer than the window. Rows without time count none.
    """
    stretch = max(3_600_000_000, 2 * window_us)
    own = F.floor(F.col(us) / stretch)
    reaches = F.pmod(F.col(us), F.lit(stretch)) > stretch - window_us
    both = F.when(reaches, F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(True).alias("own"))))
    dealt = rows.withColumn("_at", F.explode(both))
    w = Window.partitionBy(client, "_at.b").orderBy(us).rangeBetween(-(window_us - 1), 0)
    counted = dealt.withColumn("recent", F.count(us).over(w)).where("_at.own").drop("_at")
    return counted.withColumn("rapid", F.col("recent") >= least)


def session_buckets(rows: DataFrame, us: str, agent: str, width_us: int = 300_000_000) -> DataFrame:
    return rows.groupBy(F.col(agent).alias("agent_type"), F.floor(F.col(us) / width_us).alias("bucket")).agg(F.count("*").alias("events"))


def numbered_batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """batch: rows in order, `size` a batch. The numbering is one running count; it goes in two levels, so no task sees all rows."""
    from tidewright.operators.prefix import running_number

    return running_number(rows, order, "_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")


def agent_signature(user_agent: Column) -> Column:
    """struct<type, pattern> of the first signature that a user agent has; null without one."""
    out = F.lit(None).cast("struct<type:string,pattern:string>")
    for kind, patterns in reversed(AGENT_PATTERNS):
        for p in reversed(patterns):
            out = F.when(user_agent.rlike("(?i)" + regex(p)), F.struct(F.lit(kind).alias("type"), F.lit(p).alias("pattern"))).otherwise(out)
    return out


def detected_agent(user_agent: Column) -> Column:
    """The first signature that a user agent has, else Human."""
    return F.coalesce(agent_signature(user_agent)["type"], F.lit("Human"))


def agent_of_request(user_agent: Column, accept: Column) -> Column:
    """struct<type, confidence, signal>: by signature, else a bot where JSON is asked for without the mark of a browser, else a human. Nulls are empty."""
    ua, wants = F.coalesce(user_agent, F.lit("")), F.coalesce(accept, F.lit(""))
    known = agent_signature(ua)
    made = lambda kind, sure, signal: F.struct(kind.alias("type"), F.lit(sure).alias("confidence"), signal.alias("signal"))
    return F.when(known.isNotNull(), made(known["type"], 0.9, F.concat(F.lit("User-Agent matches: "), known["pattern"]))).when(
        F.contains(wants, F.lit("application/json")) & ~F.contains(ua, F.lit("Mozilla")), made(F.lit("Generic-Bot"), 0.6, F.lit("Prefers JSON, no browser signature"))
    ).otherwise(made(F.lit("Human"), 0.8, F.lit("No bot signatures detected")))


def behavior(user_agent: Column, accept: Column, client_hints: Column, recent: Column, least: int = 5) -> Column:
    """struct<accepts_json, no_scripts, rapid>: JSON is asked for; no browser's mark and no client hints; at least so many recent requests."""
    ua, wants, has = F.coalesce(user_agent, F.lit("")), F.coalesce(accept, F.lit("")), lambda c, s: F.contains(c, F.lit(s))
    plain = ~has(ua, "Mozilla") & ~has(ua, "Chrome") & ~has(ua, "Safari") & (F.coalesce(client_hints, F.lit("")) == "")
    return F.struct((has(wants, "application/json") | has(wants, "application/ld+json")).alias("accepts_json"), plain.alias("no_scripts"), (F.coalesce(recent, F.lit(0)) >= least).alias("rapid"))


def judged_agent(agent: Column, seen: Column) -> Column:
    """struct<type, confidence, signals, rendering> of agent_of_request and behavior: each sign of behavior makes a bot 0.03 surer, up to 0.99."""
    signs = F.array_compact(F.array(agent["signal"], F.when(seen["accepts_json"], "Behavior: Accepts JSON"), F.when(seen["no_scripts"], "Behavior: No JS execution"), F.when(seen["rapid"], "Behavior: Rapid requests detected")))
    sure = F.when(agent["type"] == "Human", agent["confidence"]).otherwise(F.least(F.lit(0.99), agent["confidence"] + (F.size(signs) - 1) * 0.03))
    return F.struct(agent["type"].alias("type"), F.round(sure, 6).alias("confidence"), signs.alias("signals"), recommended_rendering(agent["type"], seen["accepts_json"]).alias("rendering"))


def recommended_rendering(agent: Column, accepts_json: Column) -> Column:
    return F.when(agent == "Human", "csr").when(accepts_json, "json").otherwise("ssr")
