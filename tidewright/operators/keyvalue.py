"""A keyed table with expiry: the state behind sets and deletes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def current_values(writes: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """key, value of the keys whose last write is a set that has not expired. writes: key, value (null deletes), seq, expires_at (null never)."""
    last = writes.groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), F.col(order)).alias("w"))
    return last.where(F.col("w.value").isNotNull() & (F.col("w.expires_at").isNull() | (F.col("w.expires_at") > now))).select("key", F.col("w.value").alias("value"))


def matching(rows: DataFrame, glob: str, prefix: str = "") -> DataFrame:
    """Rows whose key behind the prefix fits a pattern in which * stands for anything."""
    pattern = "^" + re.escape(prefix) + ".*".join(re.escape(p) for p in glob.split("*")) + "$"
    return rows.where(F.col("key").rlike(pattern))
