"""The current table behind a feed of inserts, updates and deletes (problem 4).

Method: newest-first resolution. The feed is cut into ranges of change time and worked off from the newest range backwards. A key whose
newest change was met in a later range is resolved for good and leaves by an anti-join; what is left records its first-seen image or
tombstone; the base rows whose keys nothing touched are appended at the end. All reductions are aggregates that combine before the shuffle,
so a busy key never gathers its changes in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.operators.messages import micros, trimmed
from tidewright.session import materialize, path_exists, scratch_path

KEY = ["platform", "content_id"]


def change_kind(event: Column) -> Column:
    """created, updated, published, unpublished or deleted, of normalized events and of the platforms' own wordings.

    Letter case and outer blanks do not matter. Null, blank and unknown events are updates; a post moved to the trash is unpublished.
    """
    e = F.lower(trimmed(event))
    last = F.regexp_extract(e, r"([a-z]+)[^a-z]*$", 1)
    return (
        F.when(last.rlike("^(unpublish|trash)(e?d)?$"), "unpublished")
        .when(last.rlike("^publish(ed)?$"), "published")
        .when(last.rlike("^delete?d?$"), "deleted")
        .when(last.rlike("^created?$"), "created")
        .otherwise("updated")
    )


def changes(feed: DataFrame) -> DataFrame:
    """platform, content_id, us, kind, feed_seq of the rows that name a content."""
    return feed.select(
        F.col("platform"),
        trimmed(F.col("content_id")).alias("content_id"),
        micros(F.coalesce(F.col("last_modified"), F.col("received_at"))).alias("us"),
        change_kind(F.col("event")).alias("kind"),
        F.col("feed_seq").cast("long").alias("feed_seq"),
    ).where("content_id <> ''")


KINDS = ("created", "updated", "published", "unpublished", "deleted")


def newest_changes(rows: DataFrame) -> DataFrame:
    """The last change of each key. A row with key, time and kind of an earlier delivered one is a repeat and does not count.

    Of each kind only the newest time counts, and there the first delivery; so a key has five candidates at most, which are formed before the shuffle.
    """
    at = F.struct(F.coalesce("us", F.lit(-(2**63))).alias("us"), (-F.col("feed_seq")).alias("back"))
    each = [F.max(F.when(F.col("kind") == k, at)).alias(k) for k in KINDS]
    found = rows.groupBy("platform", "content_id").agg(*each)
    top = F.array_max(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.col(k)["us"].alias("us"), (-F.col(k)["back"]).alias("feed_seq"), F.lit(k).alias("kind"))) for k in KINDS]))
    return found.select(*KEY, top.alias("_t")).select(*KEY, "_t.us", "_t.feed_seq", "_t.kind")


def same_key(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in KEY])


def resolve_newest_first(rows: DataFrame, batches: int = 4) -> DataFrame:
    """platform, content_id, us, feed_seq, kind: the image or tombstone that each key ends with.

    The feed is read once, and its keys, times and kinds are written by range of change time; each range is then read from its own folder. What a range
    holds of a key is one row when it meets the keys that newer ranges resolved, so neither the join nor the sums gather a busy key.
    """
    cuts = sorted({int(c) for c in rows.approxQuantile("us", [k / batches for k in range(1, batches)], 0.01)}) if batches > 1 else []
    place = F.lit(0)
    for k, c in enumerate(cuts):
        place = F.when(F.col("us") >= c, k + 1).otherwise(place)
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "changes")
    rows.withColumn("_range", place).write.partitionBy("_range").parquet(path)
    resolved = None
    for k in reversed(range(len(cuts) + 1)):
        if not path_exists(spark, f"{path}/_range={k}"):
            continue
        part = newest_changes(spark.read.schema(rows.schema).parquet(f"{path}/_range={k}"))
        if resolved is not None:
            part = part.alias("p").join(resolved.alias("r"), same_key("p", "r"), "left_anti")
        part = materialize(part, "resolved")
        resolved = part if resolved is None else resolved.unionByName(part)
    if resolved is None:
        return newest_changes(rows)
    return resolved


def apply_changes(base: DataFrame | None, feed: DataFrame, batches: int = 4) -> DataFrame:
    """The table after the feed: rows with the feed's columns, content_id trimmed.

    A content is platform plus trimmed content_id (a null platform is a platform of its own); rows with null or blank content_id are
    ignored. received_at stands in for a null last_modified; where both are null the change is the oldest. Changes apply by time, equal
    times by feed_seq. A delete removes the content, any other change sets the whole record, also after a delete. Base rows, at most one
    per content, stay where the feed has no change of their key. Extra columns are carried along; an empty feed leaves the base.
    """
    last = resolve_newest_first(changes(feed), batches)
    # The records travel in a struct, so their columns may have any name.
    live = last.where("kind <> 'deleted'").select(F.col("feed_seq").alias("_seq"), F.col("content_id").alias("_id"))
    packed = feed.select(F.col("feed_seq").cast("long").alias("_seq"), F.struct(*[F.col(f"`{c}`") for c in feed.columns]).alias("_row"))
    fields = [(F.col("_id") if c == "content_id" else F.col("_row").getField(c)).alias(c) for c in feed.columns]
    images = packed.join(live, "_seq").select(*fields)
    if base is None:
        return images
    untouched = base.alias("p").join(last.alias("r"), same_key("p", "r"), "left_anti")
    return images.unionByName(untouched)
