"""Structured Streaming forms of the stateful operators. Event time and watermarks order the work; each gives the rows of its batch form on data in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_buckets(events: DataFrame, ts: str = "event_ts", agent: str = "agent_type", width: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Events per agent and tumbling window; rows later than the delay are dropped."""
    w = events.withWatermark(ts, delay).groupBy(F.window(ts, width), F.col(agent).alias("agent_type")).agg(F.count("*").alias("events"))
    return w.select("agent_type", F.col("window.start").alias("start"), "events")


def once_each(events: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The first delivery of each identifier within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, client: str = "client_id", ts: str = "event_ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by inactivity, given out when the watermark has passed them."""
    s = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), F.col(client).alias("client_id")).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events"))
    return s.select("client_id", "start", "end", "events")


def rapid_clients(events: DataFrame, client: str = "client_id", us: str = "us", window_us: int = 5_000_000, least: int = 5) -> DataFrame:
    """client, us, recent: each row with the client's rows in the window up to it, where they reach the least number. The state holds only times within the window."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        times = sorted(t for f in frames for t in f["us"].tolist())
        out = []
        for t in times:
            kept = [x for x in kept if t - x < window_us] + [t]
            if len(kept) >= least:
                out.append((key[0], t, len(kept)))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["client_id", "us", "recent"])

    rows = events.where(F.col(client).isNotNull() & F.col(us).isNotNull()).select(F.col(client).alias("client_id"), F.col(us).cast("long").alias("us"))
    return rows.groupBy("client_id").applyInPandasWithState(update, "client_id string, us long, recent int", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def learned_aliases(redirects: DataFrame, threshold: int = 3) -> DataFrame:
    """from_path, to_path, learned_at: when a pair was redirected `threshold` times and its path has no alias yet. The state of a path is its count per target."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, counts, alias = state.get if state.exists else ([], [], None)
        seen = dict(zip(names, counts))
        rows = sorted((s, t) for f in frames for s, t in zip(f["seq"].tolist(), f["to_path"].tolist()))
        out = []
        for seq, target in rows:
            if alias is not None:
                break
            seen[target] = seen.get(target, 0) + 1
            if seen[target] >= threshold:
                alias = target
                out.append((key[0], target, seq))
        state.update((list(seen), list(seen.values()), alias))
        yield pd.DataFrame(out, columns=["from_path", "to_path", "learned_at"])

    return redirects.select("from_path", "to_path", F.col("seq").cast("long").alias("seq")).where("from_path is not null and to_path is not null").groupBy("from_path").applyInPandasWithState(
        update, "from_path string, to_path string, learned_at long", "names array<string>, counts array<int>, alias string", "append", GroupStateTimeout.NoTimeout)


def update_velocity(updates: DataFrame, path: str = "path", ts: str = "last_modified") -> DataFrame:
    """Updates, first and last time of each path so far; the velocity follows from them."""
    return updates.where(F.col(path).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(path).alias("path")).agg(F.count("*").alias("updates"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def token_bucket(requests: DataFrame, capacity: int, refill: int, interval_us: int) -> DataFrame:
    """name, us, granted: a bucket per name, filled at first, that gains `refill` tokens for every whole interval; a request takes one or is refused."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        out = []
        for t in sorted(t for f in frames for t in f["us"].tolist()):
            if last is None:
                last = t
            steps = max(0, (t - last) // interval_us)
            tokens, last = min(capacity, tokens + steps * refill), last + steps * interval_us
            granted = tokens > 0
            tokens -= granted
            out.append((key[0], t, bool(granted)))
        state.update((int(tokens), last))
        yield pd.DataFrame(out, columns=["name", "us", "granted"])

    return requests.select("name", F.col("us").cast("long").alias("us")).groupBy("name").applyInPandasWithState(
        update, "name string, us long, granted boolean", "tokens int, last long", "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(calls: DataFrame, failures: int, timeout_us: int, successes: int) -> DataFrame:
    """name, us, state, allowed: closed until that many failures in a row; open until the timeout; then half open until that many successes. A failure while half open opens again.

    calls: name, us, ok (what the call would give)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, failed, passed, since = state.get if state.exists else ("closed", 0, 0, None)
        out = []
        for t, ok in sorted((t, bool(o)) for f in frames for t, o in zip(f["us"].tolist(), f["ok"].tolist())):
            if mode == "open" and t - since >= timeout_us:
                mode, passed = "half-open", 0
            allowed = mode != "open"
            if allowed and ok:
                failed = 0
                if mode == "half-open":
                    passed += 1
                    if passed >= successes:
                        mode = "closed"
            elif allowed:
                failed += 1
                if mode == "half-open" or failed >= failures:
                    mode, since, failed = "open", t, 0
            out.append((key[0], t, mode, allowed))
        state.update((mode, failed, passed, since))
        yield pd.DataFrame(out, columns=["name", "us", "state", "allowed"])

    return calls.select("name", F.col("us").cast("long").alias("us"), "ok").groupBy("name").applyInPandasWithState(
        update, "name string, us long, state string, allowed boolean", "mode string, failed int, passed int, since long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote to the shared folder."""
    from tidewright.session import scratch_path

    spark = stream.sparkSession
    out = scratch_path(spark, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode(mode).trigger(availableNow=True).start()
    else:
        write = lambda df, _: df.write.mode("overwrite").parquet(out)
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", out + "-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
