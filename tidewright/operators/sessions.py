"""Sessions separated by inactivity, in a table that grows by batches (problem 2).

Method: an incremental session table. A batch's events become local sessions; those are compared with the stored sessions of the days they
touch; sessions within the gap of each other, and those that a new one bridges, merge into one; the parts they lie in are replaced by one
commit of the manifest. Other days are neither read nor written.

Local sessions never sort raw events: two events in the same slot of the gap's width are at most one gap apart, so they always share a
session, and a count per (client, slot), combined before the shuffle, is all that the session rule needs. What a client has left is at most
one row per slot of time, however many events it sends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewright.operators.manifest import Manifest
from tidewright.operators.messages import micros, stored_messages, trimmed
from tidewright.session import materialize, scratch_path, shuffle_partitions

GAP_US = 1_800_000_000
DAY_US = 86_400_000_000
COLUMNS = ["client_id", "start_us", "end_us", "events"]
SCHEMA = "client_id string, start_us long, end_us long, events long"


def merge_sessions(rows: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Joins rows (client_id, start_us, end_us, events) of a client that are at most the gap apart or overlap."""
    w = Window.partitionBy("client_id").orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_us") - reach > gap_us), 1).otherwise(0)
    numbered = rows.withColumn("_opens", opens).withColumn("_n", F.sum("_opens").over(w))
    return numbered.groupBy("client_id", "_n").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("events").alias("events")
    ).drop("_n")


def local_sessions(events: DataFrame, client: str = "client_id", ts: str = "event_ts", gap_us: int = GAP_US) -> DataFrame:
    """The sessions of one batch. Rows without client (null or blank) or without time belong to none."""
    keyed = events.select(F.lower(trimmed(F.col(client))).alias("client_id"), micros(F.col(ts)).alias("us"))
    keyed = keyed.where("client_id <> '' and us is not null")
    slots = keyed.groupBy("client_id", F.floor(F.col("us") / F.lit(gap_us)).alias("_slot")) if gap_us else None
    if slots is None:  # without tolerance only equal times share a session
        slots = keyed.groupBy("client_id", F.col("us").alias("_slot"))
    rows = slots.agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("events")).drop("_slot")
    return merge_sessions(rows, gap_us)


class SessionTable:
    """client_id (trimmed, lower case), start_us, end_us, events; one part per day of the session's start.

    A session ends when more than the gap passes; exactly the gap does not end it. Repeated rows count as events of their own: take them out
    first. An empty batch changes nothing, and so does a batch id that was applied before.
    """

    def __init__(self, spark: SparkSession, gap_us: int = GAP_US, root: str | None = None):
        self.spark, self.gap = spark, gap_us
        self.root = root or scratch_path(spark, "sessions")
        self.manifest = Manifest(spark, self.root)

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def sessions(self) -> DataFrame:
        _, state = self.manifest.read()
        return self._read([p["path"] for p in state.get("days", {}).values()])

    def upsert(self, events: DataFrame, batch_id: str, client: str = "client_id", ts: str = "event_ts") -> None:
        version, state = self.manifest.read()
        days, applied = state.get("days", {}), state.get("applied", [])
        if batch_id in applied:
            return
        local = materialize(local_sessions(events, client, ts, self.gap), "local-sessions")
        # The days of a batch are as many as its time span has, however many rows it brings.
        near = F.sequence(F.floor((F.col("start_us") - self.gap) / DAY_US), F.floor((F.col("end_us") + self.gap) / DAY_US))
        touched = sorted(r[0] for r in local.select(F.explode(near)).distinct().collect())
        hit = [d for d, p in days.items() if any(int(d) <= t <= (p["end_us"] + self.gap) // DAY_US for t in touched)]
        if touched:
            merged = merge_sessions(self._read([days[d]["path"] for d in hit]).unionByName(local), self.gap)
            path = f"{self.root}/g{version + 1}"
            spread = max(1, shuffle_partitions(self.spark) // (len(touched) + len(hit)))
            merged = merged.withColumn("day", F.floor(F.col("start_us") / DAY_US)).repartition("day", F.pmod(F.hash("client_id"), F.lit(spread)))
            merged.select(*COLUMNS, "day").write.mode("overwrite").partitionBy("day").parquet(path)
            ends = self.spark.read.schema(SCHEMA + ", day long").parquet(path).groupBy("day").agg(F.max("end_us")).collect()
            days = {d: p for d, p in days.items() if d not in hit}
            days |= {str(d): {"path": f"{path}/day={d}", "end_us": e} for d, e in ends}
        self.manifest.commit(version, {"days": days, "applied": [*applied, batch_id]})


def sessions_of_messages(events: DataFrame, runs: int = 4, gap_us: int = GAP_US) -> DataFrame:
    """Sessions of the messages that remain when repeated deliveries are dropped, applied in `runs` slices of arrival."""
    kept = stored_messages(events, ["client_id", "event_ts", "ingest_batch"], runs).runs().select("_row.*")
    from tidewright.operators.messages import batch_slices

    table = SessionTable(events.sparkSession, gap_us)
    for k, part in enumerate(batch_slices(kept, "ingest_batch", runs)):
        table.upsert(part, f"slice-{k}")
    return table.sessions()
