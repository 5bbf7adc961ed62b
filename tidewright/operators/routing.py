"""Resolving requested paths to routes: exact, alias, best similar route, not found.

The similar-route step never compares every path with every route. Distinct tokens of both sides are paired on equi-keys (deletion neighbourhoods for
the edit distance, synonym groups), and the token pairs lead from path tokens to route tokens; with a threshold a path meets only routes of whose
rarest tokens it has one, which are all that can reach it. Paths without such a route have a similarity below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.functions.paths import js_round, synonym_group, token_weight, tokenize_path
from tidewright.session import materialize

EDITS = 2


def with_tokens(rows: DataFrame, path: str) -> DataFrame:
    """(path, tokens) for the distinct paths."""
    return rows.select(F.col(path).alias("path")).where("path is not null").distinct().withColumn("tokens", tokenize_path(F.col("path")))


def shortened(token: Column, edits: int) -> Column:
    """The token and what is left of it without up to `edits` (at most 2) characters. Two tokens within so many edits have one of these in common."""
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    cuts = lambda ts: F.array_distinct(F.flatten(F.transform(F.filter(ts, lambda t: F.length(t) > 0), cut)))
    out = once = F.array(token)
    for _ in range(edits):
        once = cuts(once)
        out = F.concat(out, once)
    return F.array_distinct(out)


def token_pairs(a: DataFrame, b: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b, weight) for the tokens of either side with a weight above 0. a, b: frames with the column token, distinct.

    Tokens meet under their deletion neighbourhoods, so only those that are near each other are compared; and under their synonym groups.
    """
    keyed = lambda x, name: x.select(F.col("token").alias(name), F.explode(shortened(F.col("token"), edits)).alias("k"))
    by_edit = keyed(a, "a").join(keyed(b, "b"), "k").select("a", "b").distinct().where(F.levenshtein("a", "b", edits) >= 0)
    left, right = (x.select(F.col("token").alias(n), synonym_group(F.col("token")).alias("g")).where("g is not null") for x, n in ((a, "a"), (b, "b")))
    by_group = left.join(right, "g").select("a", "b")
    return by_edit.unionByName(by_group).distinct().withColumn("weight", token_weight(F.col("a"), F.col("b"), edits))


def similar_routes(paths: DataFrame, routes: DataFrame, edits: int = EDITS, least: float = 0.0) -> DataFrame:
    """(path, route, route_ord, confidence) of every pair with a common token in the wide sense, or of those that can reach `least`. paths: path, tokens.
    routes: route, route_ord, tokens.

    A confidence of `least` needs a share of at least 2 * least - 1 of the route's tokens to be met, and so one of its 1 + floor(n * (2 - 2 * least))
    rarest; by these alone routes are found. So the tokens that most routes share lead to none that has enough others (at 0.6, of six tokens or more).
    """
    p = paths.select("path", F.size("tokens").alias("p_n"), F.posexplode("tokens").alias("p_pos", "a"))
    r = routes.select("route", "route_ord", F.size("tokens").alias("r_n"), F.posexplode("tokens").alias("r_pos", "b"))
    pairs = token_pairs(p.select(F.col("a").alias("token")).distinct(), r.select(F.col("b").alias("token")).distinct(), edits)
    if least > 0.5:
        spread_of = r.groupBy("b").agg(F.count("*").alias("df"))
        ranked = r.join(spread_of, "b").withColumn("k", F.row_number().over(Window.partitionBy("route").orderBy("df", "b", "r_pos")))
        rare = ranked.where(F.col("k") <= 1 + F.floor(F.col("r_n") * (2 - 2 * least) + 1e-9)).select("route", "b")
        led = p.select("path", "a").distinct().join(pairs.select("a", "b"), "a").join(rare, "b").select("path", "route").distinct()
        met = p.join(led, "path").join(r, "route").join(pairs, ["a", "b"])
    else:
        met = p.join(pairs, "a").join(r, "b")
    met = met.select("path", "route", "route_ord", "p_n", "r_n", "p_pos", "r_pos", "weight")
    # The best weight of every token of either side, then the sums, in one pass over the pairs' tokens.
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("p_pos").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("r_pos").alias("pos")))
    best = met.select("path", "route", "route_ord", "p_n", "r_n", "weight", F.explode(sides).alias("s")).groupBy("path", "route", "route_ord", "p_n", "r_n", "s").agg(F.max("weight").alias("w"))
    share = F.col("w") / F.when(F.col("s.side") == 0, F.col("p_n")).otherwise(F.col("r_n"))
    return best.groupBy("path", "route", "route_ord").agg(F.round(F.sum(share) / 2, 9).alias("confidence"))


def best_route(scored: DataFrame, least: float) -> DataFrame:
    """The most similar route of each path, of equal ones the first in route order; those below the threshold are left out."""
    top = F.max_by(F.struct("route", "confidence"), F.struct("confidence", (-F.col("route_ord")).alias("o"))).alias("m")
    return scored.where(F.col("confidence") >= least).groupBy("path").agg(top).select("path", "m.*")


def rank_routes(scored: DataFrame, least: float, most: int | None = None) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.desc("confidence"), "route_ord")
    out = scored.where(F.col("confidence") >= least).withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= most) if most else out


def candidate_routes(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """(path, route) that share a token exactly."""
    p = paths.select("path", F.explode(F.array_distinct("tokens")).alias("token"))
    r = routes.select("route", F.explode(F.array_distinct("tokens")).alias("token"))
    return p.join(r, "token").select("path", "route").distinct()


def relevance_sample(paths: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """The k routes of each path with the highest score: 10 for the same first segment and 1 for each segment shared. Routes without a score
    fill up in route order. Those with one are found by segment; the first k of all routes are the only ones that can fill up."""
    seg = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    p = paths.select("path", seg(F.col("path")).alias("ps"))
    r = routes.select("route", "route_ord", seg(F.col("route")).alias("rs"))
    shared = p.select("path", F.explode(F.array_distinct("ps")).alias("s")).join(
        r.select("route", "route_ord", F.explode(F.array_distinct("rs")).alias("s")), "s").groupBy("path", "route", "route_ord").agg(F.count("*").alias("shared"))
    first = lambda c: F.try_element_at(F.split(c, "/"), F.lit(2))
    hit = shared.withColumn("score", F.col("shared") + F.when(first(F.col("path")) == first(F.col("route")), 10).otherwise(0))
    filler = r.orderBy("route_ord").limit(k).select("route", "route_ord")
    none = p.select("path").join(F.broadcast(filler), F.lit(True)).join(hit.select("path", "route"), ["path", "route"], "left_anti").withColumn("score", F.lit(0).cast("long"))
    rows = hit.select("path", "route", "route_ord", "score").unionByName(none.select("path", "route", "route_ord", "score"))
    w = Window.partitionBy("path").orderBy(F.desc("score"), "route_ord")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def learned_aliases(redirects: DataFrame, threshold: int) -> DataFrame:
    """(from_path, to_path, learned_at): the alias of a path is the first pair (from, to) that was redirected `threshold` times.

    redirects: from_path, to_path, seq (order of arrival). Repeated pairs count; ties of seq go by to_path.
    """
    w = Window.partitionBy("from_path", "to_path").orderBy("seq")
    hits = redirects.withColumn("n", F.row_number().over(w)).where(F.col("n") == threshold)
    first = F.min_by(F.struct("to_path", "seq"), F.struct("seq", "to_path")).alias("f")
    return hits.groupBy("from_path").agg(first).select("from_path", F.col("f.to_path").alias("to_path"), F.col("f.seq").alias("learned_at"))


def resolve(requests: DataFrame, routes: DataFrame, aliases: DataFrame, least: float = 0.6, seq: str | None = None) -> DataFrame:
    """Each request with method (excluded, exact, alias, semantic, none), route and confidence.

    requests: any columns with `path`. routes: route, route_ord, tokens, at most one row per route. aliases: from_path, to_path, and where seq, the order of
    the requests, is given, learned_at: then only later requests use an alias. Work is done once per distinct path; a path of a third of all requests
    costs one row until the final join, whose small side is the distinct paths.
    """
    from tidewright.functions.paths import excluded

    paths = materialize(with_tokens(requests, "path").withColumn("out", excluded(F.col("path"))), "paths")
    exact = paths.where("not out").join(routes.select(F.col("route").alias("path")), "path", "left_semi").select("path", F.lit("exact").alias("method"), F.col("path").alias("route"), F.lit(1.0).alias("confidence"))
    known = aliases.where("to_path <> ''").select(F.col("from_path").alias("path"), F.col("to_path").alias("to"), (F.col("learned_at") if seq else F.lit(None)).alias("learned"))
    rest = paths.where("not out").join(routes.select(F.col("route").alias("path")), "path", "left_anti")
    similar = rest if seq else rest.join(known.select("path"), "path", "left_anti")  # before its alias is learned a path is resolved by likeness
    best = best_route(similar_routes(similar, routes, least=least), least).select("path", F.lit("semantic").alias("method"), "route", "confidence")
    skipped = paths.where("out").select("path", F.lit("excluded").alias("method"), F.lit(None).cast("string").alias("route"), F.lit(0.0).alias("confidence"))
    found = exact.unionByName(best).unionByName(skipped)
    # One row per path that resolves at all, which is all that meets the requests.
    found = paths.select("path").join(found, "path", "left").join(rest.join(known, "path").select("path", "to", "learned"), "path", "left")
    joined = requests.join(found, "path", "left")
    by_alias = F.col("to").isNotNull() & ((F.col("learned") < F.col(seq)) if seq else F.lit(True))
    by_alias = F.coalesce(by_alias, F.lit(False))
    out = joined.withColumn("method", F.when(by_alias, "alias").otherwise(F.coalesce("method", F.lit("none")))).withColumn("route", F.when(by_alias, F.col("to")).otherwise(F.col("route")))
    return out.withColumn("confidence", F.when(by_alias, 1.0).otherwise(F.round(F.coalesce("confidence", F.lit(0.0)), 6))).drop("to", "learned")


def latency_percentile(rows: DataFrame, value: str, order: str, share: float, last: int) -> DataFrame:
    """Over the last rows by order: count, mean, least, most and the value at position floor(n * share) of the sorted values."""
    recent = rows.where(F.col(value).isNotNull()).orderBy(F.desc(order)).limit(last).select(value)
    v = F.array_sort(F.collect_list(value))
    at = F.least(F.floor(F.size(v) * share), F.size(v) - 1) + 1
    return recent.agg(F.count("*").alias("n"), js_round(F.avg(value), 4).alias("average"), F.min(value).alias("least"), F.max(value).alias("most"),
                      F.try_element_at(v, at.cast("int")).alias("percentile"))
