"""Pages related by their topics: similar pairs, orphans, links, clusters.

Pages meet by blocks (see overlaps): pairs that are only counted, linked or compared never leave the call in which they are found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.operators.overlaps import BLOCK, SPARSE, UNIT, meet
from tidewright.session import materialize


def _similarity(name: str = "billionths") -> Column:
    return (F.col(name) / F.lit(float(UNIT))).alias("similarity")


def topic_pairs(pages: DataFrame, least: float, within: Sequence[str] = ()) -> DataFrame:
    """(a, b, similarity, shared) for a < b with Jaccard similarity of at least `least` > 0. pages: page, topics (distinct). Pages without topics pair with none.
    within: columns, as the site, of pages that are compared with each other only; where one is null a page pairs with none."""
    return meet(pages, least, within, "pairs").select("a", "b", _similarity(), "shared")


def sides(pages: DataFrame, least: float, within: Sequence[str] = ()) -> DataFrame:
    """(page, other, sides, similarities) of all related pairs: from how many of the two sides each is met, and how many similarities are found."""
    return meet(pages, least, within, "sides")


def orphans(pages: DataFrame, least: float, within: Sequence[str] = ()) -> DataFrame:
    return pages.select("page").join(meet(pages, least, within, "linked"), "page", "left_anti")


def link_suggestions(pages: DataFrame, least: float, within: Sequence[str] = (), block: int = BLOCK, sparse: int = SPARSE) -> DataFrame:
    """For each orphan the most similar page, the first of equals, with a priority: above 0.5 high, above 0.3 medium, else low. Pages that share no topic get none."""
    best = meet(pages, least, within, "best", block, sparse).groupBy("page").agg(F.min_by(F.struct("other", "billionths"), F.struct(-F.col("billionths"), "other")).alias("m"))
    lone = best.select("page", F.col("m.other").alias("link_to"), _similarity("m.billionths")).where(F.col("similarity") < round(least, 9))
    level = F.when(F.col("similarity") > 0.5, "high").when(F.col("similarity") > 0.3, "medium").otherwise("low")
    return lone.withColumn("priority", level)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the lowest node that can be reached. edges: source, target, in either direction.

    Large-star and small-star by turns: every node's larger neighbours are linked to its lowest neighbour, then its lower ones are, until nothing
    changes. Links only ever move to lower nodes, so paths shorten geometrically; the lowest node of a neighbourhood is a combined minimum, and no
    neighbourhood gathers in one task. Each round is written to the shared folder.
    """
    tidy = lambda e: e.where("source <> target").select(F.greatest("source", "target").alias("source"), F.least("source", "target").alias("target")).distinct()
    links = materialize(tidy(edges), "links")
    nodes = materialize(links.select(F.explode(F.array("source", "target")).alias("node")).distinct(), "nodes")

    def star(links: DataFrame, large: bool) -> DataFrame:
        """links: source > target. Large: over all neighbours, those above the node; small: over the lower ones only, and the node itself."""
        known = links.select(F.col("source").alias("u"), F.col("target").alias("v"))
        if large:
            known = known.unionByName(links.select(F.col("target").alias("u"), F.col("source").alias("v")))
        least = known.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        rest = known.join(least, "u")
        moved = rest.where("v > u").select(F.col("v").alias("source"), F.col("m").alias("target")) if large else rest.select(F.col("v").alias("source"), F.col("m").alias("target")).unionByName(least.select(F.col("u").alias("source"), F.col("m").alias("target")))
        return tidy(moved)

    while True:
        after = materialize(star(materialize(star(links, True), "large"), False), "links")
        # Both are sets of links, and equal where neither has one that the other lacks.
        same = after.join(links, ["source", "target"], "left_anti").isEmpty() and links.join(after, ["source", "target"], "left_anti").isEmpty()
        links = after
        if same:
            break
    return nodes.join(links.select(F.col("source").alias("node"), F.col("target").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def clusters(pages: DataFrame, least: float, within: Sequence[str] = ()) -> DataFrame:
    """Connected groups of at least two pages: lowest page, size, the page with most links (first of equals), the most frequent topic (first by name of equals).
    Of the links among the pages of two blocks only what connects them travels: each page with the lowest one it is connected with there."""
    met = materialize(meet(pages, least, within, "groups"), "met")
    label = components(met.select(F.col("page").alias("source"), F.col("head").alias("target")))
    degree = met.groupBy(F.col("page").alias("node")).agg(F.sum("links").alias("links"))
    groups = label.join(degree, "node").groupBy("component").agg(F.count("*").alias("pages"), F.min_by("node", F.struct(-F.col("links"), "node")).alias("central"))
    words = label.join(pages.select(F.col("page").alias("node"), F.explode("topics").alias("topic")), "node").groupBy("component", "topic").agg(F.count("*").alias("n"))
    name = words.groupBy("component").agg(F.initcap(F.min_by("topic", F.struct(-F.col("n"), "topic"))).alias("name"))
    return groups.join(name, "component", "left")
