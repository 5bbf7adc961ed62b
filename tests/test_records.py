"""Aliases, export and import, discovery and settings on small inputs with nulls, ties and empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from tidewright.operators import records as R

REDIRECTS = "from_path string, to_path string, seq long"


def test_aliases(spark):
    rows = [("/a", "/x", 1), ("/a", "/x", 2), ("/a", "/y", 3), ("/a", "/x", 4), ("/a", "/x", 9), ("/b", "/x", 5), ("/c", "/x", 1), ("/c", "/x", 8)]
    redirects = spark.createDataFrame(rows, REDIRECTS)
    requests = spark.createDataFrame([("/a", 4), ("/a", 5), ("/a", 7), ("/c", 3), (None, 1)], "path string, seq long")
    manual = spark.createDataFrame([("/c", "/hand", 2), ("/c", "/later", 6)], "from_path string, to_path string, created_at long")
    aliases = R.alias_table(redirects, requests, 3, manual)
    assert {r.from_path: (r.to_path, r.auto, r.created_at, r.hits, r.last_used_at) for r in aliases.collect()} == {"/a": ("/x", True, 4, 2, 7), "/c": ("/hand", False, 2, 1, 3)}
    pending = R.pending_counts(redirects, aliases)
    assert {(r.from_path, r.to_path): r["count"] for r in pending.collect()} == {("/a", "/y"): 1, ("/b", "/x"): 1, ("/c", "/x"): 1}
    assert tuple(R.alias_stats(aliases, pending).first()) == (2, 1, 1, 3, 3)
    none = R.alias_table(redirects.limit(0), requests, 3)
    assert tuple(R.alias_stats(none, R.pending_counts(redirects.limit(0), none)).first()) == (0, 0, 0, 0, 0)


def test_export_and_import(spark):
    schema = "id string, timestamp timestamp, path string, confidence double, agent_type string, outcome string, latency_ms double"
    t = dt.datetime(2020, 1, 2, 3, 4, 5, 678000)
    rows = [("a", t, "/x", 0.5, "Human", "404", 1.0), ("", t, "/x", 0.5, "Human", "404", 1.0), ("c", None, "/x", 0.5, "Human", "404", 1.0), ("d", t, "/x", 1.5, "Human", "404", 1.0), ("e", t, "/x", 0.5, "Bing", "404", 1.0), ("f", t, "/x", 0.5, "Human", "gone", None)]
    docs = R.exported(spark.createDataFrame(rows, schema))
    assert '"timestamp":"2020-01-02T03:04:05.678Z"' in docs.first().json and '"latency_ms":null' in docs.collect()[-1].json
    back = R.imported(docs.unionByName(spark.createDataFrame([("{broken",), ("[]",), (None,)], "json string")), schema, R.valid_miss).collect()
    assert [tuple(r) for r in back] == [rows[0]]
    own, new = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1)], [("a", 2), ("b", 4), ("b", 3)]))
    assert sorted(map(tuple, R.kept_existing(own, new, "k").collect())) == [("a", 1), ("b", 3)]


def test_discovery(spark):
    maps = [("root", [], ["one", "two", "gone", "root"]), ("one", ["/a", "/b"], ["two"]), ("two", ["/b", "/c"], ["deep"]), ("deep", ["/a", "/d"], ["root"]), ("apart", ["/z"], [])]
    df = spark.createDataFrame(maps, "url string, locs array<string>, children array<string>")
    assert [tuple(r) for r in R.discovered_routes(df, "root").collect()] == [("/a", 1), ("/b", 1), ("/c", 1), ("/d", 3 - 1)]
    assert R.discovered_routes(df, "nowhere").count() == 0 and R.discovered_routes(df, "root", 2).count() == 2


def test_ids_settings_and_reasoning(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (None, "a"), ("ab", ""), ("a|1:b", "")], "x string, y string")
    ids = [r.i for r in df.select(R.reproducible_id("cit", F.col("x"), F.col("y")).alias("i")).collect()]
    assert len(set(ids)) == 5 and all(i.startswith("cit_") and len(i) == 28 for i in ids)
    assert R.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "d": None, "e": {}}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": {}}
    lists = lambda *x: F.array(*[F.lit(s) for s in x]).cast("array<string>")
    said = spark.range(1).select(R.reasoning(lists("a", "b"), lists("a", "c"), lists("a"), F.lit(0.756)).alias("s"), R.reasoning(lists("a"), lists("c"), lists(), F.lit(0.5)).alias("n")).first()
    assert said.s == "Matched tokens: [a]. Unmatched from request: [b]. Additional in route: [c]. Confidence: 75.6%" and said.n == "No common tokens found, but structure similarity is 50.0%"
    assert R.will_split(spark.range(5), 4) and not R.will_split(spark.range(4), 4)
