"""Stored records: aliases and their use, checks, export and import, reproducible ids, discovery of routes through sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.operators.routing import learned_aliases
from tidewright.session import materialize

AGENTS = ["ChatGPT", "Perplexity", "Claude", "Gemini", "Generic-Bot", "Human"]  # fixed values; one crawler's name is not among them
OUTCOMES = ["redirected", "404", "alias-used"]


def alias_table(redirects: DataFrame, requests: DataFrame, threshold: int, manual: DataFrame | None = None) -> DataFrame:
    """(from_path, to_path, auto, created_at, hits, last_used_at): the alias of each path, and how often later requests used it.

    redirects: from_path, to_path, seq. requests: path, seq. manual: from_path, to_path, created_at. A path has one alias, the first that is created, at equal
    times the manual one; what comes later for it is neither counted nor kept.
    """
    made = learned_aliases(redirects, threshold).select("from_path", "to_path", F.lit(True).alias("auto"), F.col("learned_at").alias("created_at"))
    if manual is not None:
        made = made.unionByName(manual.select("from_path", "to_path", F.lit(False).alias("auto"), "created_at"))
    first = made.groupBy("from_path").agg(F.min_by(F.struct("to_path", "auto", "created_at"), F.struct("created_at", "auto", "to_path")).alias("a")).select("from_path", "a.*")
    used = requests.select(F.col("path").alias("from_path"), "seq").join(first.select("from_path", "created_at"), "from_path").where("seq > created_at")
    used = used.groupBy("from_path").agg(F.count("*").alias("hits"), F.max("seq").alias("last_used_at"))
    return first.join(used, "from_path", "left").withColumns({"hits": F.coalesce("hits", F.lit(0).cast("long")), "last_used_at": F.coalesce("last_used_at", "created_at")})


def pending_counts(redirects: DataFrame, aliases: DataFrame) -> DataFrame:
    """(from_path, to_path, count) of redirects that led to no alias: all of a path without one; of others what was counted until the alias, but its own."""
    known = aliases.select("from_path", F.col("to_path").alias("_to"), "created_at")
    open_ = redirects.join(known, "from_path", "left").where("created_at is null or (seq <= created_at and to_path <> _to)")
    return open_.groupBy("from_path", "to_path").agg(F.count("*").alias("count"))


def alias_stats(aliases: DataFrame, pending: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    a = aliases.agg(F.count("*").alias("total"), F.coalesce(n(F.col("auto")), F.lit(0)).alias("auto_generated"), F.coalesce(n(~F.col("auto")), F.lit(0)).alias("manual"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits"))
    return a.crossJoin(pending.agg(F.count("*").alias("pending")))  # one row each


def valid_miss(r: Column) -> Column:
    """A logged miss: id, time, path, confidence within 0 and 1, known agent and outcome, a latency that is not negative."""
    return F.coalesce((r["id"] != "") & r["timestamp"].isNotNull() & r["path"].isNotNull() & r["confidence"].between(0, 1) & r["agent_type"].isin(AGENTS) & r["outcome"].isin(OUTCOMES) & (r["latency_ms"] >= 0), F.lit(False))


def valid_alias(r: Column) -> Column:
    return F.coalesce((r["id"] != "") & r["from_path"].startswith("/") & r["to_path"].startswith("/") & (r["hits"] >= 0) & r["created_at"].isNotNull() & r["last_used_at"].isNotNull() & r["auto"].isNotNull(), F.lit(False))


def valid_visit(r: Column) -> Column:
    """An analytics record; its conversion may be null."""
    out = F.lit(True)
    for c in ("id", "timestamp", "path", "agent_type", "was_redirected", "session_id"):
        out = out & r[c].isNotNull()
    return out


def valid_measurement(measurement_id: Column, secret: Column) -> Column:
    return F.coalesce(measurement_id.startswith("G-") & (secret != ""), F.lit(False))


def reproducible_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hexadecimal digits of the parts; nulls and texts, and where one part ends, tell."""
    marked = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *marked), 256), 1, 24))


def exported(rows: DataFrame) -> DataFrame:
    """json: one document per row; times in ISO form (UTC, milliseconds), nulls as nulls."""
    times = [F.date_format(F.to_utc_timestamp(F.col(f"`{n}`"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(n) if t == "timestamp" else F.col(f"`{n}`") for n, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*times), {"ignoreNullFields": "false"}).alias("json"))


def imported(documents: DataFrame, schema: str, valid) -> DataFrame:
    """Rows of the documents (json) that parse and pass `valid`, a function of the row as a struct."""
    rows = documents.select(F.from_json("json", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"}).alias("r")).where("r is not null")
    return rows.where(valid(F.col("r"))).select("r.*")


def kept_existing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All existing rows and the new ones whose key they lack; of new ones with one key the first by all columns."""
    fresh = new.join(existing.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in new.columns])).alias("r")).select("r.*")
    return existing.select(*new.columns).unionByName(fresh)


def reasoning(path_tokens: Column, route_tokens: Column, matched: Column, confidence: Column) -> Column:
    """Why a route was chosen: which tokens match, which of the request do not, which the route has besides."""
    join = lambda a: F.array_join(a, ", ")
    rest = lambda a: F.filter(a, lambda t: ~F.array_contains(matched, t))
    some = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(label), join(a), F.lit("]"))).otherwise("")
    percent = F.format_string("%.1f%%", F.round(confidence * 100, 1))
    told = F.concat(F.lit("Matched tokens: ["), join(matched), F.lit("]"), some(". Unmatched from request: [", rest(path_tokens)), some(". Additional in route: [", rest(route_tokens)), F.lit(". Confidence: "), percent)
    return F.when(F.size(matched) == 0, F.concat(F.lit("No common tokens found, but structure similarity is "), percent)).otherwise(told)


def discovered_routes(sitemaps: DataFrame, start: str, most: int = 10_000) -> DataFrame:
    """(loc, depth): the addresses in the sitemap `start` and in all that its indexes lead to, each sitemap visited once. sitemaps: url, locs, children (arrays).

    The walk goes level by level; a level's sitemaps are found by a join, and what was visited leaves by an anti-join. At most `most` addresses, the lowest
    levels first, in order of address. A sitemap that is not there is passed over.
    """
    spark = sitemaps.sparkSession
    level, visited, found, depth, count = spark.createDataFrame([(start,)], "url string"), None, None, 0, 0
    while True:
        here = materialize(sitemaps.join(level, "url"), "sitemaps")
        visited = level if visited is None else visited.unionByName(level)
        locs = here.select(F.explode("locs").alias("loc"), F.lit(depth).alias("depth"))
        found = locs if found is None else found.unionByName(locs)
        level = materialize(here.select(F.explode("children").alias("url")).distinct().join(visited, "url", "left_anti"), "level")
        count += locs.count()
        depth += 1
        if count >= most or level.isEmpty():
            return found.groupBy("loc").agg(F.min("depth").alias("depth")).orderBy("depth", "loc").limit(most)


def will_split(entries: DataFrame, size: int = 50_000) -> bool:
    """Whether a sitemap of these entries needs several files; repeated addresses count."""
    return entries.limit(size + 1).count() > size


def merged(defaults: dict, given: dict) -> dict:
    """Settings laid over defaults: nested ones are merged, all others replaced; None keeps the default."""
    out = dict(defaults)
    for k, v in given.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = v
    return out
