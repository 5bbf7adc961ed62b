"""Sources mixed to target weights (problem 7).

Method: a low-discrepancy source schedule. Slot k of a mix lies at the fractional part of k times the golden ratio; cumulative weights map
the point to a source, so every stretch of slots holds the sources in their shares. The slots of a source are ranked, its documents are
shuffled by a keyed hash, laid end to end in repeated rounds, and cut into blocks of equal tokens; the r-th slot takes the r-th block.
Running sums go in two levels (buckets of the hash or of the slots, then within a bucket), so no source gathers in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.session import materialize

WEYL, TWO32 = 2654435769, 4294967296  # the golden ratio as a 32-bit fraction
BUCKET = 10_000  # documents or slots of a bucket, about


def source_name(c: Column) -> Column:
    """A source regardless of letter case and outer blanks; null if blank."""
    return F.nullif(F.lower(F.btrim(c, F.lit(" \t\r\n ﻿"))), F.lit(""))


def running_start(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` over all earlier rows of the group. rows has a column _bucket that rises with the order."""
    rows = rows.withColumn("_v", value)
    sums = rows.groupBy(*group, "_bucket").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_w", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return rows.join(offsets, [*group, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_w")).drop("_v", "_w", "_offset")


def plan_mixes(sized: DataFrame, targets: DataFrame, block_tokens: int | None = None, total_tokens: int | None = None) -> list[dict]:
    """One entry per mix and source with documents: weight among those, tokens per block, slots of the mix, rounds.

    The number of targets is fixed by the caller (checked); from the documents come only sums per target source. Where no total is asked
    for, a mix is as large as its scarcest source allows with all its repeats.
    """
    rows = targets.select("mix_name", source_name(F.col("doc_source")).alias("source"), F.col("target_weight").cast("double"), F.col("max_repeats").cast("int"))
    rows = rows.where("source is not null and target_weight > 0 and max_repeats > 0").groupBy("mix_name", "source").agg(
        F.sum("target_weight").alias("weight"), F.max("max_repeats").alias("repeats")).orderBy("mix_name", "source").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 targets")
    wanted = sized.sparkSession.createDataFrame([(s,) for s in sorted({r["source"] for r in rows})], "source string")
    have = {r["source"]: (r["docs"], r["tokens"]) for r in sized.join(F.broadcast(wanted), "source").groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    out = []
    for mix in dict.fromkeys(r["mix_name"] for r in rows):
        own = [r for r in rows if r["mix_name"] == mix and r["source"] in have]
        weights = sum(r["weight"] for r in own)
        if not own:
            continue
        most = min(have[r["source"]][1] * r["repeats"] * weights / r["weight"] for r in own)
        total = min(most, total_tokens) if total_tokens else most
        block = block_tokens or int(min(4096, max(64, total // 1000)))
        slots, low = max(1, int(total // block)), 0.0
        for r in own:
            docs, tokens = have[r["source"]]
            share = r["weight"] / weights
            out.append({
                "mix_name": mix, "source": r["source"], "share": share, "low": low, "high": low + share, "block": block, "slots": slots,
                "rounds": min(r["repeats"], max(1, math.ceil((share * slots + 2) * block / tokens))), "buckets": max(1, math.ceil(docs / BUCKET)), "repeats": r["repeats"],
            })
            low += share
        out[-1]["high"] = 1.0
    return out


PLAN = "mix_name string, source string, share double, low double, high double, block int, slots long, rounds int, buckets int, repeats int"


def scheduled_slots(plan: DataFrame) -> DataFrame:
    """mix_name, source, rank, slot: which source each slot belongs to, and its how-manieth of that source it is."""
    spark = plan.sparkSession
    mixes = [(r["mix_name"], r["slots"]) for r in plan.select("mix_name", "slots").distinct().collect()]
    frames = None
    for name, slots in mixes:
        one = spark.range(slots).select(F.lit(name).alias("mix_name"), F.col("id").alias("slot"))
        frames = one if frames is None else frames.unionByName(one)
    point = F.pmod(F.pmod(F.col("slot"), F.lit(2**31)) * F.lit(WEYL) + F.lit(TWO32 // 2), F.lit(TWO32)) / F.lit(float(TWO32))
    hit = frames.withColumn("p", point).join(F.broadcast(plan.select("mix_name", "source", "low", "high")), "mix_name")
    hit = hit.where((F.col("p") >= F.col("low")) & (F.col("p") < F.col("high"))).select("mix_name", "source", "slot")
    hit = hit.withColumn("_bucket", F.floor(F.col("slot") / 65536))
    return running_start(hit, ["mix_name", "source"], ["slot"], F.lit(1), "rank").select("mix_name", "source", "rank", "slot")


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int | None = None, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """mix_name, slot, doc_source, doc_id, repeat_no, tokens, position: the documents of each mix in its order (slot, position).

    documents: doc_id, source, tokens. A source is named regardless of letter case and outer blanks; documents without source or without
    a token belong to no mix. A target without documents contributes nothing and the others keep their proportions. No document is used
    more than max_repeats times, and none again before all of its source were used. Equal targets of a mix add up. Empty tables give no rows.
    """
    spark = documents.sparkSession
    sized = documents.select("doc_id", source_name(F.col("source")).alias("source"), "tokens").where("source is not null and tokens > 0")
    entries = plan_mixes(sized, targets, block_tokens, total_tokens)
    if not entries:
        return spark.createDataFrame([], "mix_name string, slot bigint, doc_source string, doc_id bigint, repeat_no int, tokens bigint, position bigint")
    columns = [c.split()[0] for c in PLAN.split(", ")]
    plan = spark.createDataFrame([tuple(e[c] for c in columns) for e in entries], PLAN)
    slots = scheduled_slots(plan)
    stream = sized.join(F.broadcast(plan), "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    h = F.xxhash64(F.lit(seed), "mix_name", "repeat_no", "doc_id")
    stream = stream.withColumn("_h", F.shiftrightunsigned(h, 1))
    stream = stream.withColumn("_bucket", (F.col("repeat_no") - 1).cast("long") * F.col("buckets") + F.pmod("_h", "buckets"))
    placed = running_start(stream, ["mix_name", "source"], ["_h", "doc_id"], F.col("tokens"), "position")
    placed = placed.withColumn("rank", F.floor((F.col("position") + F.col("tokens") / 2) / F.col("block")).cast("long"))
    placed = placed.where(F.col("position") <= (F.col("share") * F.col("slots") + 2) * F.col("block"))
    out = placed.join(slots, ["mix_name", "source", "rank"])
    return out.select("mix_name", "slot", F.col("source").alias("doc_source"), "doc_id", "repeat_no", "tokens", "position")


def deviations(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, doc_source, target_share, largest_deviation: over all beginnings of a mix, cut where a slot of the source begins or ends, the most by
    which the source's tokens differ from its share of the tokens so far, in tokens of the whole mix. Sums run in two levels, over slots, not documents."""
    slots = selection.groupBy("mix_name", "doc_source", "slot").agg(F.sum("tokens").alias("tokens")).withColumn("_bucket", F.floor(F.col("slot") / 65536))
    every = slots.groupBy("mix_name", "slot", "_bucket").agg(F.sum("tokens").alias("all_tokens"))
    every = running_start(every, ["mix_name"], ["slot"], F.col("all_tokens"), "all_before").select("mix_name", "slot", "all_before", "all_tokens")
    own = running_start(slots, ["mix_name", "doc_source"], ["slot"], F.col("tokens"), "before").select("mix_name", "doc_source", "slot", "before", "tokens")
    total = every.groupBy("mix_name").agg(F.sum("all_tokens").alias("total"))
    want = shares(selection, targets).where("tokens > 0").select("mix_name", "doc_source", "target_share")
    # Targets without documents leave their share to the others.
    want = want.join(want.groupBy("mix_name").agg(F.sum("target_share").alias("sum")), "mix_name").withColumn("target_share", F.col("target_share") / F.col("sum")).drop("sum")
    rows = own.join(every, ["mix_name", "slot"]).join(F.broadcast(want), ["mix_name", "doc_source"]).join(F.broadcast(total), "mix_name")
    off = lambda a, b: F.abs(a - F.col("target_share") * b) / F.col("total")
    most = F.greatest(off(F.col("before"), F.col("all_before")), off(F.col("before") + F.col("tokens"), F.col("all_before") + F.col("all_tokens")))
    return rows.groupBy("mix_name", "doc_source", "target_share").agg(F.round(F.max(most), 6).alias("largest_deviation"))


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and target: target share, actual share of the tokens, tokens, documents used, highest number of uses of one document."""
    want = targets.select("mix_name", source_name(F.col("doc_source")).alias("doc_source"), F.col("target_weight").cast("double").alias("w"), "max_repeats")
    want = want.where("doc_source is not null").groupBy("mix_name", "doc_source").agg(F.sum("w").alias("w"), F.max("max_repeats").alias("max_repeats"))
    want = want.withColumn("target_share", F.col("w") / F.sum("w").over(Window.partitionBy("mix_name")))
    uses = selection.groupBy("mix_name", "doc_source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    got = uses.groupBy("mix_name", "doc_source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    out = want.join(got, ["mix_name", "doc_source"], "left").fillna(0, ["tokens", "documents", "most_uses"])
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return out.select("mix_name", "doc_source", F.round("target_share", 6).alias("target_share"),
                      F.round(F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), 6).alias("actual_share"), "tokens", "documents", "most_uses", "max_repeats")
