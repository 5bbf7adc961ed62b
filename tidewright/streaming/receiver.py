"""The receiver of content changes as a stream: what an allowed platform sends is normalized, judged and counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidewright.functions import structure as S
from tidewright.operators.changefeed import change_kind
from tidewright.operators.messages import micros, trimmed


def received(changes: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """feed_seq, platform, content_id, path, kind, us and the density of the content of each change by an allowed platform that names a content.

    Row by row, so a stream needs no state for it, and a null content has the density of an empty one.
    """
    rows = changes.where(F.col("platform").isin(list(allowed)))
    named = rows.select("feed_seq", "platform", trimmed(F.col("content_id")).alias("content_id"), "path", change_kind(F.col("event")).alias("kind"), micros(F.coalesce("last_modified", "received_at")).alias("us"), S.plain_lines(F.col("content")).alias("_t"))
    parts = named.where("content_id <> ''").select("*", *[c.alias(f"_{k}") for k, c in S.breakdown(F.col("_t")).items()])
    score = S.density_score(*[F.col(f"_{k}") for k in ("tables", "bullet_lists", "statistics", "headers", "valid_hierarchy")])
    return parts.select("feed_seq", "platform", "content_id", "path", "kind", "us", score.alias("score"))


def counters(changes: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Per platform: changes received, allowed and processed, and the time of the last one; the state is one row per platform."""
    ok = F.coalesce(F.col("platform").isin(list(allowed)), F.lit(False))
    named = ok & F.coalesce(trimmed(F.col("content_id")) != "", F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    return changes.groupBy("platform").agg(F.count("*").alias("received"), n(ok).alias("allowed"), n(named).alias("processed"), F.max(micros(F.col("received_at"))).alias("last_us"))
