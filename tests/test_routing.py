"""Similar routes against all pairs, with a token that nine of ten routes share, nulls and repeated tokens; agents and aliases."""

import random

from pyspark.sql import functions as F

from tidewright.functions import paths as P
from tidewright.operators import logs as L, routing as R


def routes_of(spark, paths):
    rows = spark.createDataFrame(list(enumerate(paths)), "route_ord int, route string")
    return rows.withColumn("tokens", P.tokenize_path(F.col("route")))


def test_similar_routes_against_all_pairs(spark):
    rng = random.Random(2)
    words = ["docs", "doc", "guide", "guides", "setup", "price", "pricing", "team", "about", "ab", "a", "login", "signin"]
    made = lambda k, n: "/" + "/".join(["shared"] * k + [rng.choice(words) for _ in range(n)])
    routes = routes_of(spark, sorted({made(int(i % 10 > 0), rng.randrange(0, 9)) for i in range(60)}))
    paths = R.with_tokens(spark.createDataFrame([(made(i % 2, rng.randrange(0, 8)),) for i in range(40)] + [(None,), ("/",), ("/shred/docz",)], "path string"), "path")
    every = paths.crossJoin(routes.withColumnRenamed("tokens", "r")).select("path", "route", F.round(P.token_similarity(F.col("tokens"), F.col("r")), 9).alias("c")).where("c > 0")
    want = {(r.path, r.route): r.c for r in every.collect() if r.path != "/" and r.route != "/"}
    for least in (0.0, 0.6, 0.8):
        got = {(r.path, r.route): r.confidence for r in R.similar_routes(paths, routes, least=least).collect()}
        strong = {k: v for k, v in want.items() if v >= least}
        assert {k: v for k, v in got.items() if v >= least} == strong and strong


def test_deletion_neighbourhoods(spark):
    rng = random.Random(5)
    tokens = {"".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(150)}
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    keys = {r.token: set(r.k) for r in df.select("token", R.shortened(F.col("token"), 2).alias("k")).collect()}
    near = df.select(F.col("token").alias("a")).crossJoin(df.select(F.col("token").alias("b"))).where("levenshtein(a, b) <= 2")
    assert all(keys[r.a] & keys[r.b] for r in near.collect())


def test_an_alias_serves_later_requests_only(spark):
    routes = routes_of(spark, ["/docs/setup"])
    requests = spark.createDataFrame([(1, "/dogs/setups"), (2, "/dogs/setups"), (3, "/dogs/setups"), (4, "/zzz"), (5, "/zzz"), (6, "/docs/setup"), (7, "/api/x"), (8, None)], "n int, path string")
    aliases = spark.createDataFrame([("/dogs/setups", "/docs/setup", 2), ("/zzz", "/docs/setup", 4), ("/docs/setup", "/other", 0), ("/q", "", 0)], "from_path string, to_path string, learned_at int")
    got = {r.n: (r.method, r.route) for r in R.resolve(requests, routes, aliases, seq="n").collect()}
    assert got == {1: ("semantic", "/docs/setup"), 2: ("semantic", "/docs/setup"), 3: ("alias", "/docs/setup"), 4: ("none", None), 5: ("alias", "/docs/setup"), 6: ("exact", "/docs/setup"), 7: ("excluded", None), 8: ("none", None)}
    assert {r.method for r in R.resolve(requests, routes, aliases).where("path = '/zzz'").collect()} == {"alias"}


def test_rapid_requests_over_the_edges_of_stretches(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None] + [3_600_000_000 * rng.randrange(3) + rng.randrange(-6, 7) * 1_000_000 for _ in range(9)])) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, client string, us long")
    got = {r.i: (r.recent, r.rapid) for r in L.rapid_requests(df, "client", "us", 5_000_000, 5).collect()}
    for i, (c, us) in enumerate(rows):
        n = 0 if us is None else sum(d == c and v is not None and us - 5_000_000 < v <= us for d, v in rows)
        assert got[i] == (n, n >= 5)


def test_agents(spark):
    rows = [("GPTBot/1.0", None, None, 0), ("Mozilla/5.0", "application/json", None, 9), (None, "application/json", None, 1), ("curl", "text/html", "h", 5), ("xbot Mozilla", "application/ld+json", None, 5)]
    df = spark.createDataFrame(rows, "ua string, accept string, hints string, n int")
    a, b = L.agent_of_request(F.col("ua"), F.col("accept")), L.behavior(F.col("ua"), F.col("accept"), F.col("hints"), F.col("n"))
    got = [(r.j.type, r.j.confidence, r.j.rendering, len(r.j.signals)) for r in df.select(L.judged_agent(a, b).alias("j")).collect()]
    assert got == [("ChatGPT", 0.93, "ssr", 2), ("Human", 0.8, "csr", 3), ("Generic-Bot", 0.66, "json", 3), ("Human", 0.8, "csr", 2), ("Generic-Bot", 0.96, "json", 3)]
