"""Nodes and relations of pages whose contents are whole texts."""

import random
from collections import Counter

import pytest

from tidewright.operators import overlaps, topics
from tidewright.plans import graph


def reference_hash(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return ("-" if h < 0 else "") + format(abs(h), "x")


def test_page_nodes_hash_the_whole_content(spark, tmp_path):
    texts = ["word " * 400 + "end", "word " * 400 + "and", "x" * 60, "x" * 61, "", None]
    spark.createDataFrame([(i, f"/p{i}", "T", t) for i, t in enumerate(texts)], "feed_seq long, path string, title string, content string").write.parquet(f"{tmp_path}/cms_events.parquet")
    got = {r.feed_seq: r.content_hash for r in graph.gr03_page_nodes(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else reference_hash(t) for i, t in enumerate(texts)}


def moved(spark):
    """Rows shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """300 pages of one site that are all related, one that is related to none and one without a topic."""
    folder = str(tmp_path_factory.mktemp("alike"))
    texts = [f"alpha bravo charlie delta echoes foxtrot hotel india single{i}" for i in range(300)] + ["alpha unlike anything written elsewhere", ""]
    spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], "doc_id long, text string, site string, page_path string").write.parquet(f"{folder}/documents.parquet")
    return folder


def of_alike(spark, alike, query):
    """Its rows, if it moves far fewer rows than the 44,850 pairs that are related."""
    before = moved(spark)
    rows = query(spark, alike).collect()
    assert moved(spark) - before < 10_000
    return rows


def cases(seed=7):
    """Pages of three sites, one of them null, with frequent and rare topics, many of equal similarity."""
    rng = random.Random(seed)
    rows = [(f"p{i:03}", rng.choice(["x", "x", "x", "y", None]), rng.sample("abcdefghij", rng.randrange(0, 9)) + [f"w{rng.randrange(150)}" for _ in range(1)]) for i in range(150)]
    return rows + [("same", "x", ["a", "b"]), ("twin", "x", ["b", "a"]), ("none", "x", []), ("lone", "x", ["only", "here"])]


def similar(rows):
    """{(a, b): similarity} of all pairs of one site that share a topic, in both directions."""
    sets = [(p, s, set(t)) for p, s, t in rows if s and t]
    return {(a, b): round(len(x & y) / len(x | y), 9) for a, s, x in sets for b, u, y in sets if a != b and s == u and x & y}


def met(spark, rows, least, what, sparse, block=16):
    pages = spark.createDataFrame(rows, "page string, site string, topics array<string>")
    return overlaps.meet(pages, least, ["site"], what, block, sparse).collect()


LEASTS = pytest.mark.parametrize("least, sparse", [(0.3, 500), (0.3, 1), (0.6, 4), (1.0, 500)])


@LEASTS
def test_pairs_are_met_from_both_sides(spark, least, sparse):
    rows = cases()
    got = {tuple(r) for r in met(spark, rows, least, "sides", sparse)}
    assert got == {(a, b, 2, 1) for (a, b), s in similar(rows).items() if a < b and s >= least}


def test_symmetric_pairs_do_not_move(spark, alike):
    got = of_alike(spark, alike, graph.flt14_symmetric)
    assert sorted(map(tuple, got)) == [(a, b, 2, 1) for a in range(300) for b in range(a + 1, 300)]


@LEASTS
def test_pairs_with_what_they_share(spark, least, sparse):
    rows = cases()
    topics = {p: t for p, _, t in rows}
    got = {(r.a, r.b): (r.billionths / 1e9, r.shared) for r in met(spark, rows, least, "pairs", sparse)}
    assert got == {(a, b): (s, ",".join(t for t in topics[b] if t in topics[a])) for (a, b), s in similar(rows).items() if a < b and s >= least}


def test_topic_pairs_do_not_move(spark, alike):
    got = of_alike(spark, alike, graph.jn08_topic_pairs)
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(300) for b in range(a + 1, 300)]
    assert {(r.similarity, r.shared) for r in got} == {(0.8, "alpha,bravo,charlie,delta,echoes,foxtrot,hotel,india")}


@LEASTS
def test_groups_keep_links_and_connections(spark, least, sparse):
    rows = cases()
    edges = [k for k, s in similar(rows).items() if s >= least]
    parts = met(spark, rows, least, "groups", sparse)
    links = Counter()
    for r in parts:
        links[r.page] += r.links
    assert links == Counter(a for a, _ in edges)

    def lowest(pairs):
        low = {p: p for e in pairs for p in e}
        while any(low[a] != low[b] for a, b in pairs):
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        return low

    assert lowest([(r.page, r.head) for r in parts]) == lowest(edges)


def test_links_of_clusters_do_not_move(spark, alike):
    assert [tuple(r) for r in of_alike(spark, alike, graph.gr01_clusters)] == [(0, 300, 0, "Alpha")]


@LEASTS
def test_linked_pages(spark, least, sparse):
    rows = cases()
    assert {r.page for r in met(spark, rows, least, "linked", sparse)} == {a for (a, _), s in similar(rows).items() if s >= least}


def test_orphans_are_found_without_pairs(spark, alike):
    assert sorted(r.page for r in of_alike(spark, alike, graph.jn09_orphans)) == [300, 301]


@LEASTS
def test_link_suggestions(spark, least, sparse):
    rows = cases()
    pages = spark.createDataFrame(rows, "page string, site string, topics array<string>")
    want = {}
    for (a, b), s in similar(rows).items():
        want[a] = min(want.get(a, (0, "")), (-s, b))
    level = lambda s: "high" if s > 0.5 else "medium" if s > 0.3 else "low"
    got = topics.link_suggestions(pages, least, ["site"], 16, sparse).collect()
    assert {tuple(r) for r in got} == {(a, b, -s, level(-s)) for a, (s, b) in want.items() if -s < least}


def test_suggestions_are_found_without_pairs(spark, alike):
    assert [tuple(r) for r in of_alike(spark, alike, graph.jn10_link_suggestions)] == [(300, 0, round(1 / 13, 9), "low")]
