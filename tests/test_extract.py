"""Questions, items, comparisons, sources, graphs and streams on small inputs."""

import random

from pyspark.sql import functions as F

from tidewright.functions import extract as X
from tidewright.operators import keyvalue, prefix, topics
from tidewright.sources import cms, routes, sitemap
from tidewright.streaming import stateful


def each(spark, column, *texts):
    """The column's value for each text."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_faq(spark):
    text = "How does it work?\nA: Well.\nVery well.\n\nIs it free?\nYes."
    got = each(spark, X.faq_pairs, "Q: What is it? A: A thing.", text, "", None, "no question here", "Is it?\nIs it not?\nNo.", "first\nQuestion: Which?\n**Answer:** this\none")
    assert [[tuple(p) for p in v] for v in got] == [
        [("What is it?", "A thing.")], [("How does it work?", "Well. Very well."), ("Is it free?", "Yes.")], [], [], [], [("Is it not?", "No.")], [("Which?", "this one")]]


def test_faq_pages(spark):
    got = each(spark, X.faq_page, "Q: One? A: first\nline. Q: Two? A: other", "Why so?\n\nBecause it is long enough to say.\n\nrest", "none", None)
    assert got[0].transformed == "## Frequently Asked Questions\n\n### One?\n\nfirst\nline.\n\n### Two?\n\nother" and got[0]["items"] == 2 and got[0].confidence == 0.4
    assert got[1]["items"] == 1 and "### Why so?\n\nBecause it is long enough to say." in got[1].transformed
    assert (got[2].transformed, got[2].confidence) == ("none", 0.0) and got[3]["items"] == 0


def test_items(spark):
    got = each(spark, X.list_items, "1. **Alpha** - first one\n2. Beta: second\n- Gamma", "## One\nPrice: 5\nmore price: 6\n\n## Two\nPrice: 7\n", "This is a paragraph that is long enough. It goes on.\n\nshort", None, "- only\n## A\nx\n### B\ny: z")
    assert [(i.title, i.description) for i in got[0]] == [("Alpha", "first one"), ("Beta", "second"), ("Gamma", "")]
    assert [(i.title, i.description, i.attributes) for i in got[1]] == [("One", "Price: 5", {"price": "6"}), ("Two", "Price: 7", {"price": "7"})]
    assert [(i.title, i.description) for i in got[2]] == [("This is a paragraph that is long enough.", "It goes on.")] and got[3] == []
    assert [(i.title, i.attributes) for i in got[4]] == [("only", {}), ("A", {}), ("B", {"y": "z"})]
    made = each(spark, lambda t: X.roundup(X.list_items(t), t), "## One\nPrice: 5\n\n## Two\nb\n", "x")
    assert made[0].startswith("## Roundup: 2 Key Points\n\n### 1. One\n\nPrice: 5\n\n- **Price**: 5\n\n### 2. Two") and made[1] == "x"
    assert each(spark, lambda t: X.top_n_list(X.list_items(t), t, 2), "- a\n- b: c\n- d") == ["## Top 2 Picks\n\n### 1. a\n\n### 2. b\n\nc"]


def test_comparison(spark):
    got = each(spark, X.comparison, "|F|A|B|\n|---|---|---|\n|price|1|2|\n|size|3|\n|price|4|\n", "Alpha vs Beta. Alpha price: 5, and so on. Beta has no (cost.", "We compare C++ (fast) here", None)
    assert list(got[0]["items"]) == ["A", "B"] and [(r.attribute, list(r["values"])) for r in got[0].rows] == [("F", ["—", "—"]), ("price", ["4", "2"]), ("size", ["3", "—"])]
    assert list(got[1]["items"]) == ["Alpha", "Beta"] and [(r.attribute, list(r["values"])) for r in got[1].rows] == [("Price", ["5", "—"]), ("Cost", ["—", "—"])]
    assert [r.attribute for r in got[2].rows] == ["Feature", "Rating", "Notes"]
    table = each(spark, X.comparison_table, "|F|A|B|\n|---|---|---|\n|price|1|2|\n", "plain", None)
    assert table[0] == "| Feature | A | B |\n| --- | --- | --- |\n| F | — | — |\n| price | 1 | 2 |" and table[1:] == ["plain", None]


def test_steps(spark):
    got = each(spark, X.steps, "2. two\n1. one\n1. again", "Step 2: b\nstep 1: a\n3. c", "", "99999999999999999999. far")
    assert [[(s.position, s.text) for s in v] for v in got] == [[(1, "one"), (1, "again"), (2, "two")], [(1, "a"), (2, "b")], [], [(None, "far")]]


def test_facts(spark):
    from tidewright.functions import gain as I

    text = "# The API\n**Google** sold 5 million phones and 42 more, v2.1.0 on March 3, 2024 for $1,200.50; Foo beats Bar: Foo vs Bar, see https://a.example/x. AI PayPal top 10 JavaScript"
    got, none, null = each(spark, I.unique_entities, text, "", None)
    want = {"API", "Google", "5 million", "v2.1.0", "March 3, 2024", "$1,200.50", "https://a.example/x.", "AI", "PayPal", "top 10", "JavaScript", "Foo", "Bar", "2.1", "200.50"}
    assert want - {"2.1", "200.50"} <= set(got) <= want and none == [] == null
    score = lambda t: I.information_gain(I.unique_entities(t), I.stock_share(t))
    assert each(spark, score, "", None, "5 million users", "words without facts") == [50, 50, 54, 50]
    more = each(spark, score, *[" ".join(["word"] * 40 + [f"Pay{c}al" for c in "BCDEFGHIJ"[:k]]) for k in range(9)])
    assert more == sorted(more)


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(70)] + [("x", "y"), ("z", "z")] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(50)]
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in topics.components(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert got == {n: root(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    assert topics.components(spark.createDataFrame([], "source string, target string")).count() == 0


def test_topic_pairs(spark):
    rng = random.Random(4)
    rows = [(f"p{i:03}", list({rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 9))})) for i in range(80)] + [("same", ["a", "b"]), ("twin", ["b", "a"])]
    pages = spark.createDataFrame(rows, "page string, topics array<string>")
    for least in (0.3, 0.5, 1.0):
        got = {(r.a, r.b) for r in topics.topic_pairs(pages, least).collect()}
        want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= least}
        assert got == want


def test_running_number(spark):
    df = spark.createDataFrame([(i * 3 % 101,) for i in range(101)], "k long")
    assert sorted((r.k, r.n) for r in prefix.running_number(df, "k", "n", 8).collect()) == [(i, i) for i in range(101)]
    assert prefix.running_number(df.limit(0), "k", "n").count() == 0


def test_sitemaps(spark, tmp_path):
    xml = '﻿<?xml version="1.0"?><urlset><!-- <url><loc>/no</loc></url> --><url><loc> /a?x=1&y=&#50;&amp;lt; </loc><priority>2</priority></url><url><loc>mailto:x</loc></url><url></url></urlset>'
    (tmp_path / "s.xml").write_text(xml)
    rows = sitemap.parse_sitemap(sitemap.read_sitemaps(spark, str(tmp_path)), "xml").collect()
    assert [(r["loc"], r.priority) for r in rows] == [("/a?x=1&y=2<", None)]


def test_file_routes(spark, tmp_path):
    for f in ("app/page.tsx", "app/(g)/shop/[id]/page.ts", "app/_x/page.tsx", "app/api/page.tsx", "app/@s/page.js", "app/docs/layout.tsx", "app/docs/page.jsx"):
        p = tmp_path / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    assert sorted(r.path for r in routes.filesystem_routes(spark, str(tmp_path)).collect()) == ["/", "/docs", "/shop/[id]"]


def test_signatures_and_rich_text(spark):
    import base64
    import hashlib
    import hmac

    mac = hmac.new(b"k", b"body", hashlib.sha256)
    good = [("contentful", base64.b64encode(mac.digest()).decode()), ("sanity", mac.hexdigest()), ("custom", "k"), ("custom", mac.hexdigest())]
    bad = [("contentful", mac.hexdigest()), ("strapi", "no"), ("wordpress", None)]
    df = spark.createDataFrame([(p, "body", s) for p, s in good + bad], "p string, b string, s string")
    assert [r.v for r in df.select(cms.signature_valid(F.col("p"), F.col("b"), F.col("s"), "k").alias("v")).collect()] == [True] * 4 + [False] * 3
    tree = '{"nodeType":"document","content":[{"nodeType":"p","content":[{"nodeType":"text","value":"Hello"},{"nodeType":"text","value":"world"}]}]}'
    df = spark.createDataFrame([(tree,), ("no json",), (None,)], "t string")
    assert [r.x for r in df.select(cms.rich_text(F.col("t")).alias("x")).collect()] == ["Hello world", None, None]


def test_key_values(spark):
    rows = spark.createDataFrame([("a", "1", 1, None), ("a", None, 2, None), ("b", "1", 1, 5), ("c", "1", 1, 50), ("d", "x", 1, None), ("d", "y", 2, None)], "key string, value string, seq long, expires_at long")
    assert sorted((r.key, r.value) for r in keyvalue.current_values(rows, F.lit(10)).collect()) == [("c", "1"), ("d", "y")]


def stream_of(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / "in")
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts == 1 else rows[len(rows) * k // parts : len(rows) * (k + 1) // parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_stream_limiter_and_breaker(spark, tmp_path):
    s = stream_of(spark, tmp_path, [("a", t) for t in (0, 1, 2, 3, 100, 101)], "name string, us long", 1)
    out = stateful.run_to_table(stateful.token_bucket(s, 2, 1, 50), "limiter").orderBy("us").collect()
    assert [r.granted for r in out] == [True, True, False, False, True, True]
    calls = [("x", t, ok) for t, ok in ((0, False), (1, False), (2, True), (20, True), (21, True), (22, False))]
    s = stream_of(spark, tmp_path / "b", calls, "name string, us long, ok boolean", 1)
    out = stateful.run_to_table(stateful.circuit_breaker(s, 2, 10, 2), "breaker").orderBy("us").collect()
    assert [(r.state, r.allowed) for r in out] == [("closed", True), ("open", True), ("open", False), ("half-open", True), ("closed", True), ("closed", True)]


def test_stream_sessions_and_dedup(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2020, 1, 1)
    rows = [("c", "e1", t0), ("c", "e1", t0), ("c", "e2", t0 + dt.timedelta(minutes=20)), ("c", "e3", t0 + dt.timedelta(hours=3)), ("c", "e4", t0 + dt.timedelta(days=3))]
    schema = "client_id string, event_id string, event_ts timestamp"
    s = stream_of(spark, tmp_path, rows, schema, 1)
    once = stateful.run_to_table(stateful.once_each(s, "event_id", "event_ts"), "once")
    assert once.count() == 4
    out = stateful.run_to_table(stateful.sessions(stream_of(spark, tmp_path / "s", rows, schema, 1)), "sessions").orderBy("start").collect()
    assert [r.events for r in out][:2] == [3, 1]


PRODUCT = "# Red kettle\nPrice: $25.00 USD. In stock, SKU: rk-12. Add to cart or buy now. Free shipping and a rating: 4.5 for this product of steel."
FAQ = "Frequently asked questions\nQ: What is it? A: A thing that does what it should do, every day. Q: Is it good? A: It is, we think."
ARTICLE = "# On tea\nPublished on March 5, 2020 by Mira Hadlland. 7 min read. A blog article about tea with many words, so that it is long enough."


def test_entities(spark):
    from tidewright.functions import entities as E

    texts = [PRODUCT, FAQ, ARTICLE, "", None, "short text", "add to cart $5"]
    df = E.with_entities(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, t string, entities_of string"), "t")
    got = [r.entities for r in sorted(df.collect(), key=lambda r: r.i)]
    assert (got[0][0].type, got[0][0].name) == ("Product", "Red kettle") and got[0][0].properties == {"price": "25.00", "priceCurrency": "USD", "availability": "https://schema.org/InStock"}
    assert "FAQ" in [e.type for e in got[1]] and got[2][0].type == "Article" and got[2][0].properties == {"datePublished": "March 5, 2020", "author": "Mira Hadlland"}
    assert got[3] == got[4] == got[5] == [] and got[6][0].type == "Product" and got[6][0].name == "Product"
    names = each(spark, lambda t: E.name_of(t, F.lit("Person")), "by: Ann Lee", "x", "<h1 class=a> T </h1>")
    assert names == ["Ann Lee", "Person", "T"]
    long = "w" * 300
    assert each(spark, E.description_of, f"# T\nshort\n{long}", "*a* [b]", "") == ["w" * 200, "a b", ""]


def test_structured_data(spark):
    import json

    from tidewright.functions import entities as E

    df = E.with_entities(spark.createDataFrame([(0, PRODUCT), (1, FAQ), (2, ARTICLE), (3, "")], "i int, t string"), "t").withColumn("d", E.schema_graph(F.col("entities")))
    same = F.array(F.lit("https://x.example/me"))
    more = E.with_trust_signals(F.col("d"), author=F.lit('Mira "M"'), same_as=same, job_title=F.lit("Editor"), publisher=F.lit("P"), logo=F.lit("l.png"), date_modified=F.lit("2024-01-01"), reviewer=F.lit(None).cast("string"), citations=F.array(F.lit("u")))
    rows = sorted(df.select("i", "d", E.valid_jsonld(F.col("d")).alias("v"), E.script_tag(F.col("d")).alias("s"), more.alias("more")).collect(), key=lambda r: r.i)
    graphs = [json.loads(r.d)["@graph"] for r in rows]
    assert [g["@type"] for g in graphs[0]][:2] == ["WebPage", "Product"] and graphs[0][1]["offers"] == {"@type": "Offer", "price": "25.00", "priceCurrency": "USD", "availability": "https://schema.org/InStock"}
    faq = next(g for g in graphs[1] if g["@type"] == "FAQ")
    assert [q["name"] for q in faq["mainEntity"]] == ["What is it?", "Is it good?"] and faq["mainEntity"][1]["acceptedAnswer"]["text"] == "It is, we think."
    assert [r.v for r in rows] == [True, True, True, False] and graphs[3] == [] and rows[0].s.startswith("<script")
    article = json.loads(rows[2].more)["@graph"]
    assert article[0]["dateModified"] == "2024-01-01" and "author" not in article[0]
    assert article[1]["author"] == {"@type": "Person", "name": 'Mira "M"', "jobTitle": "Editor", "sameAs": ["https://x.example/me"]} and article[1]["publisher"]["logo"]["url"] == "l.png"
    assert article[1]["datePublished"] == "March 5, 2020" and article[1]["citation"] == [{"@type": "WebPage", "url": "u"}] and "reviewedBy" not in article[1]
    assert [g.get("author") for g in json.loads(rows[0].more)["@graph"]] == [None, None]
    who = spark.range(1).select(E.person(F.lit("A"), F.lit("https://l.example/a"), F.array(F.lit("x"), F.lit("https://l.example/a"))).alias("p")).first().p
    assert json.loads(who)["sameAs"] == ["https://l.example/a", "x"]
    bad = spark.createDataFrame([("{",), ('{"@context":1}',), ('{"@context":"https://schema.org","@graph":[{"name":"x"}]}',)], "d string")
    assert bad.where(E.valid_jsonld(F.col("d"))).count() == 0


def test_how_to(spark):
    import json

    from tidewright.functions import entities as E

    got = each(spark, E.how_to_steps, " 1. cut\n2. glue\n", "step 1: cut it step 2. glue it", "First, cut it. Then, glue it. Finally, wait", "nothing")
    assert [[(s.name, s.text) for s in v] for v in got] == [[("Step 1", "cut"), ("Step 2", "glue")], [("Step 1", "cut it"), ("Step 2", "glue it")], [("Step 1", "cut it."), ("Step 2", "glue it."), ("Step 3", "wait")], []]
    doc = json.loads(each(spark, lambda t: E.how_to(F.lit("Glue"), E.how_to_steps(t), tool=F.array(F.lit("knife")), total_time=F.lit("PT5M")), "1. cut\n2. glue")[0])
    assert doc["step"][1] == {"@type": "HowToStep", "position": 2, "name": "Step 2", "text": "glue"} and doc["tool"] == [{"@type": "HowToTool", "name": "knife"}] and doc["totalTime"] == "PT5M"
