"""Analytics events: building them and flattening them to name and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.functions.paths import js_round


def route_event(requested: Column, matched: Column, method: Column) -> dict[str, Column]:
    """Name and action of a route resolution."""
    redirected = matched.isNotNull() & (method != "none")
    return {"event_name": F.when(redirected, "geo_route_redirected").otherwise("geo_route_not_found"), "category": F.lit("route_resolution"),
            "action": F.when(redirected, "redirected").otherwise("not_found"), "page_location": requested}


def flattened(events: DataFrame) -> DataFrame:
    """delivery_id, name, params: a map of texts without nulls. Scores are in hundredths; the custom dimensions carry a prefix."""
    t = lambda c: c.cast("string")
    fixed = {
        "event_category": F.col("event_category"), "event_action": F.col("event_action"), "session_id": F.col("session_id"), "client_id": F.col("client_id"), "page_location": F.col("page_location"),
        "page_title": F.col("page_title"), "agent_type": F.col("agent_type"), "is_ai_agent": t(F.col("is_ai_agent")), "fact_density_score": t(js_round(F.col("geo_metrics.fact_density_score") * 100)),
        "processing_time_ms": t(js_round(F.col("geo_metrics.processing_time_ms"))), "requested_path": F.col("route_details.requested_path"), "matched_path": F.col("route_details.matched_path"),
        "match_method": F.col("route_details.match_method"),
    }
    own = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fixed.items()]), lambda e: e["value"].isNotNull()))
    custom = F.transform_keys(F.coalesce("custom_dimensions", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("custom_"), k))
    return events.select("delivery_id", F.col("event_name").alias("name"), F.map_concat(own, F.map_filter(custom, lambda _, v: v.isNotNull())).alias("params"))


def not_found_payload(path: Column, suggestions: Column, timed_out: bool = False) -> Column:
    """The structured answer to a path that leads nowhere."""
    message = "could not be resolved within the time limit." if timed_out else "was not found."
    return F.struct(F.lit("NOT_FOUND").alias("error"), F.lit(404).alias("code"), F.concat(F.lit('The requested path "'), path, F.lit(f'" {message}')).alias("message"),
                    path.alias("requested_path"), suggestions.alias("suggestions"), F.lit(timed_out).alias("timed_out"))


def agent_is_ai(agent: Column) -> Column:
    return F.when(agent.isNotNull(), agent != "Human")


def page_event(page: Column, agent: Column, scores: dict[str, Column]) -> dict[str, Column]:
    """An analysed page with its scores."""
    return {"event_name": F.lit("geo_page_analyzed"), "category": F.lit("page_analysis"), "action": F.lit("analyzed"), "page_location": page, "is_ai_agent": agent_is_ai(agent), "metrics": F.struct(*[c.alias(k) for k, c in scores.items()])}


def citation_event(domain: Column, authority: Column, sentiment: Column, earned: Column) -> dict[str, Column]:
    return {"event_name": F.lit("geo_citation_discovered"), "category": F.lit("citation_discovery"), "action": F.lit("discovered"),
            "details": F.struct(domain.alias("source_domain"), authority.alias("domain_authority"), sentiment.alias("sentiment"), earned.alias("is_earned_media"))}


def schema_event(page: Column, types: Column, signed: Column, valid: Column) -> dict[str, Column]:
    return {"event_name": F.lit("geo_schema_generated"), "category": F.lit("schema_generation"), "action": F.lit("generated"), "page_location": page,
            "details": F.struct(types.alias("entity_types"), signed.alias("has_eeat"), valid.alias("validation_passed"))}


def agent_event(page: Column, agent: Column, confidence: Column, signals: Column) -> dict[str, Column]:
    return {"event_name": F.lit("geo_agent_detected"), "category": F.lit("agent_detection"), "action": F.lit("detected"), "page_location": page, "is_ai_agent": agent != "Human", "confidence": confidence,
            "detection_signals": F.array_join(signals, ",")}


def freshness_event(page: Column, stale: Column, priority: Column) -> dict[str, Column]:
    return {"event_name": F.when(stale, "geo_content_stale").otherwise("geo_content_fresh"), "category": F.lit("freshness_check"), "action": F.when(stale, "stale_detected").otherwise("analyzed"), "page_location": page, "priority": priority}
