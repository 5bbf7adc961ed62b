"""Mentions of a brand: authority, sentiment, store statistics, reputation graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.functions.paths import js_round, let
from tidewright.lexicons import words as L
from tidewright.operators.logs import count_if


def domain_authority(domain: Column) -> Column:
    """Listed score; else that of the first listed domain it contains; else by ending (.gov 85, .edu 80, .org 50), else 30."""
    d = F.regexp_replace(F.lower(domain), r"^www\.", "")
    out = F.when(d.endswith(".gov"), 85).when(d.endswith(".edu"), 80).when(d.endswith(".org"), 50).otherwise(30)
    for name, score in reversed(L.DOMAIN_AUTHORITY):
        out = F.when(d.contains(name), score).otherwise(out)
    exact = F.create_map(*[F.lit(x) for kv in L.DOMAIN_AUTHORITY for x in kv])
    return F.when(domain.isNull(), None).otherwise(F.coalesce(F.try_element_at(exact, d), out))


def is_earned(domain: Column, brands: Sequence[str]) -> Column:
    out = F.lit(True)
    for b in brands:
        out = out & ~F.lower(domain).contains(b.lower())
    return out


def sentiment(text: Column) -> Column:
    """positive, negative or neutral: words of both lists, turned by a negation within the three words before; phrases count 3; sarcasm swaps the
    sides at half weight."""
    split = lambda t: F.filter(F.split(t, r"\W+"), lambda w: w != "")
    contraction = r"\b(?:don't|doesn't|didn't|won't|wouldn't|can't|couldn't|shouldn't|isn't|aren't|wasn't|weren't|haven't|hasn't|hadn't)\b"
    listed = lambda ws: F.array(*[F.lit(w) for w in ws])
    count = lambda a, f: F.size(F.filter(a, f))

    def places(counts: Column) -> Column:
        """The numbers of the words that contractions begin with; each contraction is two words itself."""
        return F.transform(counts, lambda _, i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0), lambda a, n: a + n) + i * 2)

    def contractions(low: Column) -> Column:
        before = F.split(low, contraction)
        return let(F.transform(F.slice(before, F.lit(1), F.greatest(F.size(before) - 1, F.lit(0))), lambda t: F.size(split(t))), places)

    def scores(low: Column, numbered: Column, at: Column) -> Column:
        """numbered: words of either list or negators, with their number and kind."""
        turned = lambda s: F.exists(at, lambda p: (s["i"] > p) & (s["i"] <= p + 3))
        good, bad = F.filter(numbered, lambda s: s["k"] == 1), F.filter(numbered, lambda s: s["k"] == 2)
        phrases = lambda ps: 3.0 * count(listed(ps), lambda p: F.contains(low, p))
        p = phrases(L.POSITIVE_PHRASES) + count(good, lambda s: ~turned(s)) + 0.5 * count(bad, turned)
        n = phrases(L.NEGATIVE_PHRASES) + count(good, turned) + count(bad, lambda s: ~turned(s))
        sarcasm = low.rlike(r"\b(?:yeah right|sure thing|oh great|just great|wonderful\.{2,}|amazing\.{2,})")
        return F.when(sarcasm, (n - p) * 0.5).otherwise(p - n)

    kinds = F.create_map(*[F.lit(x) for ws, k in ((L.NEGATION_WORDS, 0), (L.POSITIVE_WORDS, 1), (L.NEGATIVE_WORDS, 2)) for w in ws for x in (w, k)])

    def difference(low: Column) -> Column:
        known = F.filter(F.transform(split(low), lambda w, i: F.struct(i.alias("i"), F.try_element_at(kinds, w).alias("k"))), lambda s: s["k"].isNotNull())
        return let(known, lambda v: let(F.concat(F.transform(F.filter(v, lambda s: s["k"] == 0), lambda s: s["i"]), contractions(low)), lambda at: scores(low, v, at)))

    diff = let(F.lower(text), difference)
    return F.when(text.isNull(), None).otherwise(let(diff, lambda d: F.when(d > 1, "positive").when(d < -1, "negative").otherwise("neutral")))


def store_stats(rows: DataFrame) -> DataFrame:
    s = lambda v: count_if(F.col("sentiment") == v).alias(v)
    return rows.agg(F.count("*").alias("total"), count_if(F.col("is_earned_media")).alias("earned"), count_if(~F.col("is_earned_media")).alias("owned"),
                    s("positive"), s("neutral"), s("negative"), F.coalesce(js_round(F.avg("domain_authority")), F.lit(0)).alias("avg_authority"))


def citation_authority(rows: DataFrame) -> DataFrame:
    """Weighted mean of authority: earned media weighs 1.5; positive mentions count 1.2, negative 0.5; at most 100; 0 when empty."""
    w = F.when(F.col("is_earned_media"), 1.5).otherwise(1.0)
    m = F.when(F.col("sentiment") == "positive", 1.2).when(F.col("sentiment") == "negative", 0.5).otherwise(1.0)
    value = F.try_divide(F.sum(F.coalesce("domain_authority", F.lit(0)) * w * m), F.sum(w))
    return rows.agg(F.least(js_round(F.coalesce(value, F.lit(0.0))), F.lit(100)).alias("authority"))


def keep_first(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by order, through an aggregate that combines before the shuffle."""
    all_columns = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*key).agg(F.min_by(all_columns, F.col(order)).alias("_r")).select("_r.*")


def reddit_authority(score: Column, comments: Column, subreddit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in L.SUBREDDIT_BONUS for x in kv])
    bonus = F.coalesce(F.try_element_at(table, F.lower(subreddit)), F.lit(L.SUBREDDIT_DEFAULT))
    return F.least(F.lit(100), js_round(30 + 10 * F.log10(F.greatest(F.lit(1), score + 2 * comments)) + bonus))


def hackernews_authority(points: Column, comments: Column) -> Column:
    return F.least(F.lit(100), js_round(60 + 15 * F.log10(F.greatest(F.lit(1), points + 3 * comments))))


def github_authority(stars: Column, forks: Column) -> Column:
    return F.least(F.lit(100), js_round(50 + 10 * F.log10(F.greatest(F.lit(1), stars)) + 5 * F.log10(F.greatest(F.lit(1), forks))))


def node_authority(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, authority: the mean of source authority times weight over the incoming edges, at most 100; its own where none comes in.

    nodes: id, authority. edges: source, target, weight. A missing source adds 0 but counts.
    """
    source = nodes.select(F.col("id").alias("source"), F.col("authority").alias("a"))
    came = edges.join(source, "source", "left").groupBy(F.col("target").alias("id")).agg(js_round(F.avg(F.coalesce("a", F.lit(0)) * F.col("weight"))).alias("mean"))
    return nodes.join(came, "id", "left").select("id", F.coalesce(F.least("mean", F.lit(100)), F.col("authority")).alias("authority"))


def geo_score(parts: dict[str, Column]) -> Column:
    """The rounded mean of the components."""
    return js_round(sum(parts.values()) / len(parts))
