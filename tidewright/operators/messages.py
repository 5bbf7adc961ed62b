"""Exactly one copy of each message that was delivered at least once (problem 5).

Method: an idempotent upsert into hash-bucketed, sorted storage by identifier. Each upsert reduces its batch to one row per identifier
(combined before the shuffle, so an identifier that holds a third of all rows costs one row per map task) and appends it as a sorted run,
bucketed by the identifier. Compaction reads every run of a bucket in one task - no shuffle, as all runs share the bucketing - and lets
equal identifiers collapse to the one that sorts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewright.operators.manifest import Manifest
from tidewright.session import delete_path, scratch_path, shuffle_partitions

BLANKS = " \t\r\n\x0b\x0c ﻿"
LAST = 9223372036854775807


def trimmed(c: Column) -> Column:
    """Without outer blanks, tabs, line breaks and no-break spaces."""
    return F.btrim(c, F.lit(BLANKS))


def micros(c: Column) -> Column:
    """A timestamp as microseconds since 1970 (UTC)."""
    return F.unix_micros(c.cast("timestamp"))


class MessageStore:
    """One row per message: ``_key``, ``_ts`` (microseconds, null as the highest value), ``_id`` and the payload columns in struct ``_row``.

    Equal means: equal identifiers without outer blanks and letter case. A null identifier is a message of its own, told apart by the
    delivery id; an empty one is an identifier like any other. The earliest timestamp is kept (null counts as latest), of equal ones the
    lowest delivery id. A delivery that comes again with the same delivery id is the same delivery. The payload travels in a struct, so
    extra columns may have any name. An empty batch adds an empty run. Upserting a batch id that is already there changes nothing.
    """

    def __init__(self, spark: SparkSession, payload: Sequence[str] = (), id_col: str = "event_id", ts_col: str = "event_ts",
                 delivery_col: str = "delivery_id", root: str | None = None, buckets: int | None = None):
        self.spark, self.payload = spark, list(payload)
        self.id_col, self.ts_col, self.delivery_col = id_col, ts_col, delivery_col
        self.root = root or scratch_path(spark, "messages")
        self.manifest = Manifest(spark, self.root)
        version, state = self.manifest.read()
        if not version:
            state = {"buckets": buckets or shuffle_partitions(spark), "generation": 0, "runs": []}
            version = self.manifest.commit(0, state)
        self.buckets = state["buckets"]
        self._known = 0

    def _open(self, version: int, state: dict) -> None:
        """Makes the runs that another application wrote known to this one, with their buckets, which the manifest holds."""
        if version == self._known or not state.get("schema"):
            return
        table, path = self._table(state["generation"]), f"{self.root}/g{state['generation']}".replace("'", "\\'")
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(
                f"CREATE TABLE {table} ({state['schema']}) USING parquet PARTITIONED BY (_run) "
                f"CLUSTERED BY (_key) SORTED BY (_key, _ts, _id) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self.spark.sql(f"MSCK REPAIR TABLE {table}")
        self._known = version

    def _table(self, generation: int) -> str:
        return f"tw_messages_{hashlib.sha256(self.root.encode()).hexdigest()[:12]}_{generation}"

    def _write(self, rows: DataFrame, run: int, generation: int) -> None:
        name = self._table(generation)
        rows = rows.withColumn("_run", F.lit(run))
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        w = rows.write.mode("append").format("parquet").option("path", f"{self.root}/g{generation}")
        w.partitionBy("_run").bucketBy(self.buckets, "_key").sortBy("_key", "_ts", "_id").saveAsTable(name)

    def _reduced(self, rows: DataFrame) -> DataFrame:
        first = F.min_by(F.struct("_ts", "_id", "_row"), F.struct("_ts", "_id")).alias("_w")
        return rows.groupBy("_key").agg(first).select("_key", "_w._ts", "_w._id", "_w._row")

    def keyed(self, batch: DataFrame) -> DataFrame:
        own = F.concat(F.lit("k"), F.lower(trimmed(F.col(self.id_col))))
        return batch.select(
            F.coalesce(own, F.concat(F.lit("n"), F.col(self.delivery_col).cast("string")), F.lit("n")).alias("_key"),
            F.coalesce(micros(F.col(self.ts_col)), F.lit(LAST)).alias("_ts"),
            F.col(self.delivery_col).cast("long").alias("_id"),
            F.struct(*[F.col(c) for c in self.payload] or [F.lit(True).alias("_none")]).alias("_row"),
        )

    def upsert(self, batch: DataFrame, batch_id: str) -> None:
        version, state = self.manifest.read()
        if any(r["batch"] == batch_id for r in state["runs"]):
            return
        run = state.get("next", 0)
        self._open(version, state)
        # A run that a failed attempt left behind is not in the manifest, and its number is taken again: it is written over.
        self._drop_run(state["generation"], run)
        rows = self._reduced(self.keyed(batch))
        self._write(rows.repartition(self.buckets, "_key"), run, state["generation"])
        state["runs"].append({"batch": batch_id, "run": run})
        self._known = self.manifest.commit(version, state | {"next": run + 1, "schema": self.schema})

    def _drop_run(self, generation: int, run: int) -> None:
        delete_path(self.spark, f"{self.root}/g{generation}/_run={run}")

    def runs(self) -> DataFrame:
        """All rows of the live runs."""
        version, state = self.manifest.read()
        self._open(version, state)
        live = [r["run"] for r in state["runs"]]
        return self.spark.table(self._table(state["generation"])).where(F.col("_run").isin(live) if live else F.lit(False))

    def messages(self) -> DataFrame:
        """One row per message, over all runs: the rows of a bucket meet in one task without a shuffle."""
        return self._reduced(self.runs().select("_key", "_ts", "_id", "_row"))

    def compact(self) -> None:
        """Merges all runs into one of the next generation and switches to it; the older files stay, until `vacuum`, for readers that still use them."""
        version, state = self.manifest.read()
        if len(state["runs"]) < 2:
            return
        after = state["generation"] + 1
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(after)}")
        delete_path(self.spark, f"{self.root}/g{after}")
        self._write(self.messages(), 0, after)
        batches = [{"batch": r["batch"], "run": 0} for r in state["runs"]]
        self._known = self.manifest.commit(version, state | {"generation": after, "runs": batches, "next": 1})


    def vacuum(self) -> None:
        """Removes older generations and states. Not while others read them."""
        _, state = self.manifest.read()
        for g in range(state["generation"]):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(g)}")
            delete_path(self.spark, f"{self.root}/g{g}")
        self.manifest.vacuum()


def batch_slices(df: DataFrame, by: str, runs: int) -> list[DataFrame]:
    """The rows in `runs` slices of about equal ranges of `by`, in ascending order; nulls are in the first. No row is left out."""
    lo, hi = df.agg(F.min(by), F.max(by)).first()
    if lo is None or runs < 2 or hi == lo:
        return [df]
    cuts = sorted({int(lo) + (int(hi) - int(lo)) * k // runs for k in range(1, runs)} - {int(lo)})
    edges = [None, *cuts, None]
    c = F.col(by)
    out = []
    for a, b in zip(edges, edges[1:]):
        cond = F.lit(True)
        if a is not None:
            cond = cond & (c >= a)
        if b is not None:
            cond = cond & (c < b)
        out.append(df.where(cond if a is not None else cond | c.isNull()))
    return out


def stored_messages(events: DataFrame, payload: Sequence[str] = (), runs: int = 4) -> MessageStore:
    """Upserts the deliveries in `runs` slices of ingest_batch, then compacts."""
    store = MessageStore(events.sparkSession, payload)
    for k, part in enumerate(batch_slices(events, "ingest_batch", runs)):
        store.upsert(part, f"slice-{k}")
    store.compact()
    return store


def repeated_deliveries(events: DataFrame, runs: int = 4) -> DataFrame:
    """delivery_id of every row that is not the kept one of its message."""
    kept = stored_messages(events, runs=runs).runs().select(F.col("_id").alias("delivery_id"))
    rows = events.where(F.col("event_id").isNotNull()).select(F.col("delivery_id").cast("long").alias("delivery_id"))
    return rows.join(kept, "delivery_id", "left_anti")
