"""Age, staleness and update velocity of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.functions.paths import js_round
from tidewright.operators.messages import micros


def age_in_days(last_modified: Column, now: Column) -> Column:
    """Whole spans of 24 hours."""
    return F.floor((micros(now) - micros(last_modified)) / 86_400_000_000)


def refresh_priority(age: Column, threshold: int) -> Column:
    return F.when(age >= 2 * threshold, "critical").when(age >= threshold, "high").when(age >= threshold / 2, "medium").otherwise("low")


def freshness(rows: DataFrame, now: Column, threshold: int) -> DataFrame:
    """rows: path, last_modified. Stale is strictly above the threshold."""
    age = age_in_days(F.col("last_modified"), now)
    return rows.where("last_modified is not null").withColumn("age_days", age).withColumn("is_stale", F.col("age_days") > threshold).withColumn(
        "refresh_priority", refresh_priority(F.col("age_days"), threshold))


def velocity(rows: DataFrame) -> DataFrame:
    """Updates per 30 days of each path, in two digits: (n - 1) over the span; 0 for a single update or no span."""
    g = rows.where("last_modified is not null and path is not null").groupBy("path").agg(
        F.count("*").alias("updates"), F.min(micros(F.col("last_modified"))).alias("a"), F.max(micros(F.col("last_modified"))).alias("b"))
    months = (F.col("b") - F.col("a")) / 2_592_000_000_000.0
    return g.select("path", "updates", F.coalesce(js_round(F.when((F.col("updates") > 1) & (months > 0), F.try_divide(F.col("updates") - 1, months)), 2), F.lit(0.0)).alias("velocity"))
