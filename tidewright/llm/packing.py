"""Documents in containers of a fixed capacity (problem 6).

Method: bound-certified repacking. Items are dealt to partitions of bounded size by hash; each partition packs its items best-fit decreasing
and computes lower bounds on its number of containers from dual feasible functions. A partition that meets its bound is certified, no packing
of its items needs fewer. Partitions with a gap give the documents of all their containers that are not full, and every partition those of
its emptiest container, into an exchange; the exchanged documents are dealt anew and packed again, and the new packing stands if it needs no
more containers than they had. Only sizes and ids travel, never texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewright.llm.tokens import VOCABULARY, token_count
from tidewright.session import materialize

GROUP = 20_000  # items of a partition, about
PACKED = "setting_name string, capacity int, doc_id bigint, part int, from_token bigint, tokens int, bin string, used int, gap int, emptiest boolean"


def lower_bound(sizes: dict[int, int], capacity: int) -> int:
    """The best bound on the number of containers for {size: number} that these dual feasible functions give:
    the cut functions (large items count whole, small ones not at all) and the rounding functions of up to 100 steps."""
    items = sorted((s, n) for s, n in sizes.items() if n > 0 and s > 0)
    if not items:
        return 0
    best = -(-sum(s * n for s, n in items) // capacity)
    values = [s for s, _ in items]
    # cut: for every threshold k <= capacity / 2
    prefix_n, prefix_s = [0], [0]
    for s, n in items:
        prefix_n.append(prefix_n[-1] + n)
        prefix_s.append(prefix_s[-1] + s * n)
    from bisect import bisect_left, bisect_right

    for k in sorted({v for v in values if 2 * v <= capacity} | {capacity - v + 1 for v in values if 2 * v > capacity and 2 * (capacity - v + 1) <= capacity}):
        a, b = bisect_left(values, k), bisect_right(values, capacity - k)
        best = max(best, prefix_n[-1] - prefix_n[b] + -(-(prefix_s[b] - prefix_s[a]) // capacity))
    for k in range(1, 101):
        # in units of 1 / (k * capacity)
        total = sum(n * (s * k if (k + 1) * s % capacity == 0 else (k + 1) * s // capacity * capacity) for s, n in items)
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item: largest first, each into the fullest container that takes it. Ties go by position."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, rooms, open_rooms, bins = [0] * len(sizes), {}, 0, 0
    for i in order:
        s = sizes[i]
        fit = open_rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            b, room, bins = bins, capacity, bins + 1
        out[i] = b
        room -= s
        if room:
            rooms.setdefault(room, []).append(b)
            open_rooms |= 1 << room
    return out


def items_of(sizes: DataFrame, settings: DataFrame) -> DataFrame:
    """(setting_name, capacity, doc_id, part, from_token, tokens): a text above the capacity is cut into full parts and a rest, others are whole.

    sizes: doc_id, tokens. settings: setting_name, capacity; a fixed handful of rows, which is checked.
    """
    known = settings.limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("more than 1000 settings")
    small = F.broadcast(settings.sparkSession.createDataFrame([tuple(r) for r in known], settings.schema))
    rows = sizes.where("tokens > 0").crossJoin(small)
    parts = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))
    rows = rows.withColumn("part", F.explode(parts)).withColumn("from_token", F.col("part").cast("long") * F.col("capacity"))
    size = F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("from_token")).cast("int")
    return rows.select("setting_name", F.col("capacity").cast("int").alias("capacity"), "doc_id", "part", "from_token", size.alias("tokens"))


def _pack_group(prefix: str):
    """The packing of one partition, as a function of (key, rows)."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        setting, group = key
        pdf = pdf.sort_values(["doc_id", "part"], kind="stable").reset_index(drop=True)
        capacity = int(pdf["capacity"].iloc[0])
        sizes = pdf["tokens"].tolist()
        bins = best_fit_decreasing(sizes, capacity)
        used: dict[int, int] = {}
        for b, s in zip(bins, sizes):
            used[b] = used.get(b, 0) + s
        counts: dict[int, int] = {}
        for s in sizes:
            counts[s] = counts.get(s, 0) + 1
        gap = len(used) - lower_bound(counts, capacity)
        emptiest = min(used, key=lambda b: (used[b], b))
        pdf["bin"] = [f"{prefix}{group}.{b}" for b in bins]
        pdf["used"] = [used[b] for b in bins]
        pdf["gap"], pdf["emptiest"] = gap, [b == emptiest for b in bins]
        return pdf[["setting_name", "capacity", "doc_id", "part", "from_token", "tokens", "bin", "used", "gap", "emptiest"]]

    return pack


def _packed(items: DataFrame, prefix: str, group_size: int) -> DataFrame:
    """Each item with its container; groups by hash, so that none grows with a source or a site."""
    counts = {r[0]: r[1] for r in items.groupBy("setting_name").count().collect()}
    groups = F.lit(1)
    for name, n in counts.items():
        same = F.col("setting_name").eqNullSafe(F.lit(name))
        groups = F.when(same, F.lit(max(1, math.ceil(n / group_size)))).otherwise(groups)
    dealt = items.withColumn("grp", F.pmod(F.xxhash64(F.lit(prefix), "doc_id", "part"), groups).cast("long"))
    return dealt.groupBy("setting_name", "grp").applyInPandas(_pack_group(prefix), PACKED)


def pack(items: DataFrame, rounds: int = 2, group_size: int = GROUP) -> DataFrame:
    """Each item (setting_name, capacity, doc_id, part, from_token, tokens) with its container: columns bin and used. Partitions above their bound
    exchange documents and pack again `rounds` times at most, or until that gains nothing.

    Items are between 1 token and the capacity. Full items fill a container of their own without being dealt.
    """
    keep = ["setting_name", "capacity", "doc_id", "part", "from_token", "tokens", "bin", "used"]
    full = items.where("tokens = capacity")
    single = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.col("part").cast("string"))
    done = [full.withColumn("bin", single).withColumn("used", F.col("tokens")).select(keep)]
    state = materialize(_packed(items.where("tokens < capacity"), "a", group_size), "packed")
    for r in range(rounds):
        give = (F.col("used") < F.col("capacity")) & ((F.col("gap") > 0) | F.col("emptiest"))
        pool = state.where(give)
        before = {x[0]: x[1] for x in pool.groupBy("setting_name").agg(F.countDistinct("bin")).collect()}
        if not before:
            break
        again = materialize(_packed(pool.select("setting_name", "capacity", "doc_id", "part", "from_token", "tokens"), "bcdefgh"[r % 7], group_size), "repacked")
        after = {x[0]: x[1] for x in again.groupBy("setting_name").agg(F.countDistinct("bin")).collect()}
        better = [s for s in before if after[s] <= before[s]]
        ok = F.col("setting_name").isin(better) if better else F.lit(False)
        done.append(state.where(~(give & ok)).select(keep))
        state = again.where(ok)
        if not any(after[s] < before[s] for s in better):
            break
    return _all([*done, state.select(keep)])


def _all(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def document_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens; written down, as each text is to be tokenized once."""
    return materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("text"), vocabulary).alias("tokens")), "sizes")


def pack_settings(settings: DataFrame) -> DataFrame:
    return settings.where("purpose = 'pack' and max_tokens > 0").select("setting_name", F.col("max_tokens").alias("capacity"))


def containers(packed: DataFrame) -> DataFrame:
    """setting_name, container, capacity, used_tokens, unused_tokens, items: one row per container, which holds at most `capacity` items.

    Texts without a token (null, empty) need no container. A document that comes twice is two items. An empty table has no containers.
    """
    item = F.struct("doc_id", "part", "from_token", "tokens")
    return packed.groupBy("setting_name", F.col("bin").alias("container"), "capacity").agg(
        F.sum("tokens").cast("int").alias("used_tokens"), F.array_sort(F.collect_list(item)).alias("items")
    ).select("setting_name", "container", "capacity", "used_tokens", (F.col("capacity") - F.col("used_tokens")).alias("unused_tokens"), "items")


def packing_certificates(packed: DataFrame) -> DataFrame:
    """setting_name, partition, containers, least_containers, certified: what each partition of the finished packing holds against the bound that no
    packing of its items can go below. Items that fill a container each are partition f. A partition's sizes are at most `capacity` rows."""
    part = F.regexp_extract("bin", r"^(f|[a-h]\d+)", 1).alias("partition")
    rows = packed.select("setting_name", "capacity", part, "bin", "tokens")
    bins = rows.groupBy("setting_name", "partition").agg(F.countDistinct("bin").alias("containers"))
    sizes = rows.groupBy("setting_name", "partition", "capacity", "tokens").count()

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        least = lower_bound(dict(zip(pdf["tokens"].tolist(), pdf["count"].tolist())), int(pdf["capacity"].iloc[0]))
        return pd.DataFrame({"setting_name": pdf["setting_name"].iloc[:1], "partition": pdf["partition"].iloc[:1], "least_containers": [least]})

    bounds = sizes.groupBy("setting_name", "partition").applyInPandas(bound, "setting_name string, partition string, least_containers bigint")
    return bins.join(bounds, ["setting_name", "partition"]).withColumn("certified", F.col("containers") == F.col("least_containers"))


def packing_report(packed: DataFrame) -> DataFrame:
    """Per setting: containers, the bound no packing can go below, items, tokens and unused share. The bound needs only the number of items
    of each size, at most `capacity` rows."""
    bins = packed.groupBy("setting_name", "capacity").agg(
        F.countDistinct("bin").alias("containers"), F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    sizes = packed.groupBy("setting_name", "capacity", "tokens").count()

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["capacity"].iloc[0])
        b = lower_bound(dict(zip(pdf["tokens"].tolist(), pdf["count"].tolist())), c)
        return pd.DataFrame({"setting_name": pdf["setting_name"].iloc[:1], "capacity": [c], "least_containers": [b]})

    bounds = sizes.groupBy("setting_name", "capacity").applyInPandas(bound, "setting_name string, capacity int, least_containers bigint")
    out = bins.join(bounds, ["setting_name", "capacity"])
    return out.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
