"""Queries on paths and routes, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import paths as P
from tidewright.lexicons.words import EXCLUDED_PATHS, SYNONYMS
from tidewright.operators import routing as R
from tidewright.plans.problems import read


def routes(spark, sf):
    return read(spark, sf, "routes").select(F.col("path").alias("route"), "route_ord", P.tokenize_path(F.col("path")).alias("tokens"))


def requests(spark, sf):
    """Deliveries with a requested path."""
    e = read(spark, sf, "geo_events")
    return e.select("delivery_id", F.col("route_details.requested_path").alias("path"), F.col("route_details.matched_path").alias("matched")).where("path is not null")


def pairs(spark, sf):
    return requests(spark, sf).where("matched is not null").select("path", "matched").distinct()


def aliases(spark, sf):
    e = read(spark, sf, "geo_events").where("route_details.match_method = 'semantic'")
    e = e.select(F.col("route_details.requested_path").alias("from_path"), F.col("route_details.matched_path").alias("to_path"), F.col("delivery_id").alias("seq"))
    return R.learned_aliases(e.where("from_path is not null and to_path is not null"), 3)


def flt01_excluded(spark, sf):
    return requests(spark, sf).groupBy(P.excluded(F.col("path")).alias("is_excluded")).agg(F.count("*").alias("requests"))


def str01_tokens(spark, sf):
    return R.with_tokens(requests(spark, sf), "path").select("path", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n"))


def str02_joined_tokens(spark, sf):
    t = R.with_tokens(requests(spark, sf), "path")
    return t.select("path", F.concat(F.lit("/"), F.array_join("tokens", "/")).alias("joined"))


def str03_semantic_tokens(spark, sf):
    return requests(spark, sf).select("path").distinct().select("path", F.array_join(P.semantic_tokens(F.col("path")), " ").alias("tokens"))


def str04_token_overlap(spark, sf):
    return pairs(spark, sf).select("path", "matched", F.round(P.jaccard(P.tokenize_path(F.col("path")), P.tokenize_path(F.col("matched"))), 9).alias("overlap"))


def str05_levenshtein(spark, sf):
    return pairs(spark, sf).select("path", "matched", F.levenshtein("path", "matched").alias("distance"))


def str06_jaro_winkler(spark, sf):
    return pairs(spark, sf).select("path", "matched", F.round(P.jaro_winkler(F.col("path"), F.col("matched")), 9).alias("similarity"))


def _tokens(spark, sf):
    return R.with_tokens(requests(spark, sf), "path").select(F.explode("tokens").alias("token")).distinct()


def str07_soundex(spark, sf):
    return _tokens(spark, sf).select("token", P.soundex(F.col("token")).alias("code"))


def str08_ngram_similarity(spark, sf):
    return pairs(spark, sf).select("path", "matched", F.round(P.ngram_similarity(F.col("path"), F.col("matched")), 9).alias("similarity"))


def str09_cosine_similarity(spark, sf):
    slash = lambda c: F.replace(F.col(c), F.lit("/"), F.lit(" "))
    return pairs(spark, sf).select("path", "matched", F.round(P.cosine_similarity(slash("path"), slash("matched")), 9).alias("similarity"))


def str11_path_similarity(spark, sf):
    return pairs(spark, sf).select("path", "matched", F.round(P.token_similarity(P.tokenize_path(F.col("path")), P.tokenize_path(F.col("matched"))), 9).alias("similarity"))


def str12_synonym_group(spark, sf):
    return _tokens(spark, sf).select("token", P.synonym_group(F.col("token")).alias("synonym_group"))


def str13_without_words(spark, sf):
    t = read(spark, sf, "discovered_citations")
    return t.select("citation_id", P.without_words(F.col("title"), ["the", "a", "regular", "thread"]).alias("title"))


def str15_url_path(spark, sf):
    return read(spark, sf, "geo_events").select("page_location").distinct().select("page_location", P.url_path(F.col("page_location")).alias("path"))


def str16_url_domain(spark, sf):
    return read(spark, sf, "discovered_citations").select("citation_id", P.url_domain(F.col("source_url")).alias("domain"))


def str17_content_hash(spark, sf):
    return read(spark, sf, "cms_events").select("feed_seq", P.content_hash(F.col("content")).alias("hash"))


def str18_topic_hash(spark, sf):
    return read(spark, sf, "cms_events").select("feed_seq", P.topic_hash(F.col("title")).alias("hash"))


def flt12_same_semantics(spark, sf):
    p = pairs(spark, sf)
    return p.select("path", "matched", (P.semantic_tokens(F.col("path")) == P.semantic_tokens(F.col("matched"))).alias("same"))


def flt13_soundex_match(spark, sf):
    first = lambda c: P.soundex(F.coalesce(F.try_element_at(P.tokenize_path(F.col(c)), F.lit(-1)), F.lit("")))
    return pairs(spark, sf).select("path", "matched", (first("path") == first("matched")).alias("same"))


def jn01_exact_routes(spark, sf):
    return requests(spark, sf).join(routes(spark, sf).select(F.col("route").alias("path")), "path", "left_semi").select("delivery_id", "path")


def jn02_alias_targets(spark, sf):
    a = aliases(spark, sf).select(F.col("from_path").alias("path"), "to_path")
    return requests(spark, sf).join(a, "path", "left").select("delivery_id", "path", "to_path")


def _scored(spark, sf, least=0.0):
    return R.similar_routes(R.with_tokens(requests(spark, sf), "path"), routes(spark, sf), least=least)


def jn03_best_match(spark, sf):
    return R.best_route(_scored(spark, sf, 0.6), 0.6).select("path", "route", F.round("confidence", 6).alias("confidence"))


def jn04_rank_routes(spark, sf):
    return R.rank_routes(_scored(spark, sf), 0.5).select("path", "route", F.round("confidence", 6).alias("confidence"), "rank")


def jn05_batch_matches(spark, sf):
    best = jn03_best_match(spark, sf)
    return requests(spark, sf).select("delivery_id", "path").join(best, "path", "left").select("delivery_id", "path", "route", "confidence")


def jn06_candidate_routes(spark, sf):
    return R.candidate_routes(R.with_tokens(requests(spark, sf), "path"), routes(spark, sf))


def jn17_relevance_sample(spark, sf):
    return R.relevance_sample(R.with_tokens(requests(spark, sf), "path"), routes(spark, sf), 5).select("path", "route", "score", "rank")


def win03_suggestions(spark, sf):
    return R.rank_routes(_scored(spark, sf, 0.6), 0.6, 3).select("path", "route", "rank")


def agg17_combined_scores(spark, sf):
    """Weighted mean of three measures; weights need not add up."""
    p = pairs(spark, sf)
    w = {"overlap": 0.5, "edit": 0.2, "gram": 0.4}
    s = {"overlap": P.jaccard(P.tokenize_path(F.col("path")), P.tokenize_path(F.col("matched"))),
         "edit": 1 - F.levenshtein("path", "matched") / F.greatest(F.length("path"), F.length("matched")),
         "gram": P.ngram_similarity(F.col("path"), F.col("matched"))}
    return p.select("path", "matched", F.round(sum(s[k] * w[k] for k in w) / sum(w.values()), 6).alias("score"))


def gr06_inverted_index(spark, sf):
    r = routes(spark, sf).select("route", F.explode("tokens").alias("token"))
    return r.groupBy("token").agg(F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"))


def stm03_learned_aliases(spark, sf):
    return aliases(spark, sf)


def stm05_resolve(spark, sf):
    out = R.resolve(requests(spark, sf).select("delivery_id", "path"), routes(spark, sf), aliases(spark, sf), seq="delivery_id")
    return out.select("delivery_id", "path", "method", "route", "confidence")


# ---------------------------------------------------------------- SQL twins
_DEC = "CASE WHEN position('%' IN {0}) > 0 THEN url_decode({0}) ELSE {0} END"
_TOK = "list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '^/+|/+$', '', 'g'), '[/_-]+'), lambda t: lower(trim(t))), lambda t: t <> '')"


def tok(c):
    return _TOK.format("(" + _DEC.format(c) + ")")


_REQ = """req AS (SELECT delivery_id, route_details.requested_path AS path, route_details.matched_path AS matched FROM geo_events WHERE route_details.requested_path IS NOT NULL),
prs AS (SELECT DISTINCT path, matched FROM req WHERE matched IS NOT NULL)"""
_SYN = "CASE " + " ".join(
    f"WHEN {{0}} IN ({', '.join(repr(w) for w in ws)}) THEN {i}" for i, g in enumerate(SYNONYMS) if (ws := [w for w in g if not any(w in h for h in SYNONYMS[:i])])
) + " END"


def syn(c):
    return _SYN.replace("{0}", c)


_W = f"CASE WHEN a = b THEN 1.0 WHEN coalesce({syn('a')} = {syn('b')}, false) THEN 0.8 WHEN abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= 2 THEN 0.8 ELSE 0.0 END"
_SCORED = f"""WITH {_REQ},
p AS (SELECT path, t FROM (SELECT path, {tok('path')} AS t FROM (SELECT DISTINCT path FROM req))),
r AS (SELECT path AS route, route_ord, {tok('path')} AS t FROM routes),
pt AS (SELECT path, len(t) AS pn, unnest(range(len(t))) AS pp, unnest(t) AS a FROM p),
rt AS (SELECT route, route_ord, len(t) AS rn, unnest(range(len(t))) AS rp, unnest(t) AS b FROM r),
tw AS (SELECT a, b, {_W} AS w FROM (SELECT DISTINCT a FROM pt), (SELECT DISTINCT b FROM rt)),
m AS (SELECT path, route, route_ord, pn, rn, pp, rp, w FROM pt JOIN tw USING (a) JOIN rt USING (b) WHERE w > 0),
f AS (SELECT path, route, route_ord, pn, rn, sum(w) AS fw FROM (SELECT path, route, route_ord, pn, rn, pp, max(w) AS w FROM m GROUP BY ALL) GROUP BY ALL),
g AS (SELECT path, route, sum(w) AS bw FROM (SELECT path, route, rp, max(w) AS w FROM m GROUP BY ALL) GROUP BY ALL),
scored AS (SELECT path, route, route_ord, round((CAST(fw AS DOUBLE) / pn + CAST(bw AS DOUBLE) / rn) / 2, 9) AS confidence FROM f JOIN g USING (path, route)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, route_ord) AS rank FROM scored),
best AS (SELECT path, route, round(confidence, 6) AS confidence FROM ranked WHERE rank = 1 AND confidence >= 0.6)"""
_ALIAS = """al0 AS (SELECT route_details.requested_path AS from_path, route_details.matched_path AS to_path, delivery_id AS seq FROM geo_events
    WHERE route_details.match_method = 'semantic' AND route_details.requested_path IS NOT NULL AND route_details.matched_path IS NOT NULL),
al1 AS (SELECT *, row_number() OVER (PARTITION BY from_path, to_path ORDER BY seq) AS n FROM al0),
al AS (SELECT from_path, to_path, seq AS learned_at FROM (SELECT *, row_number() OVER (PARTITION BY from_path ORDER BY seq, to_path) AS k FROM al1 WHERE n = 3) WHERE k = 1)"""
_JAC = "CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))) END"
_GRAM = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr(lower({0}), i, 2)))"
_DICE = "CASE WHEN path = matched THEN 1.0 ELSE 2.0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)) END"
_EXCL = " OR ".join(f"starts_with(path, '{p}')" for p in EXCLUDED_PATHS)


def sdx(c):
    u = f"regexp_replace(upper({c}), '[^A-Z]', '', 'g')"
    code = lambda s: f"translate({s}, 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000')"
    z = f"replace({code(u)}, '0', '')"
    for d in "123456":
        z = f"regexp_replace({z}, '{d}+', '{d}', 'g')"
    own = code(f"substr({u}, 1, 1)")
    return f"CASE WHEN {u} = '' THEN '' ELSE rpad(substr({u}, 1, 1) || CASE WHEN {own} <> '0' AND substr({z}, 1, 1) = {own} THEN substr({z}, 2) ELSE {z} END, 4, '0') END"


_TOKENS = f"toks AS (SELECT DISTINCT unnest({tok('path')}) AS token FROM (SELECT DISTINCT path FROM req))"
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(replace({0}, '/', ' ')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"
_HASH = "list_reduce(list_prepend({1}::BIGINT, list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * {2} + c) % 4294967296)"

ORACLES = {
    "flt01_excluded": f"WITH {_REQ} SELECT ({_EXCL}) AS is_excluded, count(*) AS requests FROM req GROUP BY 1",
    "str01_tokens": f"WITH {_REQ}, t AS (SELECT path, {tok('path')} AS t FROM (SELECT DISTINCT path FROM req)) SELECT path, array_to_string(t, ' ') AS tokens, len(t) AS n FROM t",
    "str02_joined_tokens": f"WITH {_REQ} SELECT path, '/' || array_to_string({tok('path')}, '/') AS joined FROM (SELECT DISTINCT path FROM req)",
    "str03_semantic_tokens": f"WITH {_REQ} SELECT path, array_to_string(list_sort(list_distinct({tok('path')})), ' ') AS tokens FROM (SELECT DISTINCT path FROM req)",
    "str04_token_overlap": f"WITH {_REQ}, t AS (SELECT path, matched, {tok('path')} AS x, {tok('matched')} AS y FROM prs) SELECT path, matched, round({_JAC}, 9) AS overlap FROM t",
    "str05_levenshtein": f"WITH {_REQ} SELECT path, matched, levenshtein(path, matched) AS distance FROM prs",
    "str06_jaro_winkler": "SELECT DISTINCT route_details.requested_path AS path, route_details.matched_path AS matched, round(jaro_winkler_similarity(route_details.requested_path, route_details.matched_path), 9) AS similarity FROM geo_events WHERE route_details.requested_path IS NOT NULL AND route_details.matched_path IS NOT NULL",
    "str07_soundex": f"WITH {_REQ}, {_TOKENS} SELECT token, {sdx('token')} AS code FROM toks",
    "str08_ngram_similarity": f"WITH {_REQ}, t AS (SELECT path, matched, {_GRAM.format('path')} AS gx, {_GRAM.format('matched')} AS gy FROM prs) SELECT path, matched, round({_DICE}, 9) AS similarity FROM t",
    "str09_cosine_similarity": f"""WITH {_REQ}, t AS (SELECT path, matched, {_WORDS.format('path')} AS x, {_WORDS.format('matched')} AS y FROM prs),
        v AS (SELECT *, list_distinct(list_concat(x, y)) AS v FROM t),
        c AS (SELECT *, list_transform(v, lambda w: len(list_filter(x, lambda q: q = w))) AS p, list_transform(v, lambda w: len(list_filter(y, lambda q: q = w))) AS q FROM v)
        SELECT path, matched, round(CASE WHEN path = matched THEN 1.0 ELSE coalesce(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * q[i]))
        / nullif(sqrt(list_sum(list_transform(p, lambda z: z * z))) * sqrt(list_sum(list_transform(q, lambda z: z * z))), 0), 0) END, 9) AS similarity FROM c""",
    "str11_path_similarity": f"""WITH {_REQ}, t AS (SELECT path, matched, {tok('path')} AS x, {tok('matched')} AS y FROM prs),
        e AS (SELECT path, matched, len(x) AS n, len(y) AS k, unnest(range(len(x))) AS i, unnest(x) AS a, y FROM t),
        f AS (SELECT path, matched, n, k, i, a, unnest(range(len(y))) AS j, unnest(y) AS b FROM e),
        w AS (SELECT *, {_W} AS w FROM f),
        s AS (SELECT path, matched, sum(m) / any_value(n) AS s FROM (SELECT path, matched, n, i, max(w) AS m FROM w GROUP BY ALL) GROUP BY ALL),
        u AS (SELECT path, matched, sum(m) / any_value(k) AS u FROM (SELECT path, matched, k, j, max(w) AS m FROM w GROUP BY ALL) GROUP BY ALL)
        SELECT t.path, t.matched, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE (s + u) / 2 END, 9) AS similarity
        FROM t LEFT JOIN s USING (path, matched) LEFT JOIN u USING (path, matched)""",
    "str12_synonym_group": f"WITH {_REQ}, {_TOKENS} SELECT token, {syn('token')} AS synonym_group FROM toks",
    "str13_without_words": "SELECT citation_id, array_to_string(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '' AND lower(w) NOT IN ('the', 'a', 'regular', 'thread')), ' ') AS title FROM discovered_citations",
    "str15_url_path": r"""SELECT page_location, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_location,
        regexp_replace(regexp_replace(page_location, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS p FROM (SELECT DISTINCT page_location FROM geo_events))""",
    "str16_url_domain": r"SELECT citation_id, regexp_replace(regexp_extract(lower(source_url), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)', 1), '^www\.', '') AS domain FROM discovered_citations",
    "str17_content_hash": f"""SELECT feed_seq, lpad(lower(hex((h * 33 + length(content)) % 4294967296)), 8, '0') || '_' || length(content) AS hash FROM (
        SELECT feed_seq, content, {_HASH.format("substr(content, 1, 1000)", 5381, 33)} AS h FROM cms_events)""",
    "str18_topic_hash": f"""SELECT feed_seq, CASE WHEN s < 0 THEN '-' ELSE '' END || lower(hex(abs(s))) AS hash FROM (
        SELECT feed_seq, CASE WHEN title IS NULL THEN NULL WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS s FROM (SELECT feed_seq, title, {_HASH.format("title", 0, 31)} AS h FROM cms_events))""",
    "flt12_same_semantics": f"WITH {_REQ} SELECT path, matched, list_sort(list_distinct({tok('path')})) = list_sort(list_distinct({tok('matched')})) AS same FROM prs",
    "flt13_soundex_match": f"""WITH {_REQ}, t AS (SELECT path, matched, coalesce({tok('path')}[-1], '') AS x, coalesce({tok('matched')}[-1], '') AS y FROM prs)
        SELECT path, matched, ({sdx('x')}) = ({sdx('y')}) AS same FROM t""",
    "jn01_exact_routes": f"WITH {_REQ} SELECT delivery_id, path FROM req WHERE path IN (SELECT path FROM routes)",
    "jn02_alias_targets": f"WITH {_REQ}, {_ALIAS} SELECT delivery_id, path, to_path FROM req LEFT JOIN al ON path = from_path",
    "jn03_best_match": f"{_SCORED} SELECT * FROM best",
    "jn04_rank_routes": f"{_SCORED} SELECT path, route, round(confidence, 6) AS confidence, rank FROM ranked WHERE confidence >= 0.5",
    "jn05_batch_matches": f"{_SCORED} SELECT delivery_id, path, route, confidence FROM req LEFT JOIN best USING (path)",
    "jn06_candidate_routes": f"""WITH {_REQ}, a AS (SELECT path, unnest({tok('path')}) AS t FROM (SELECT DISTINCT path FROM req)), b AS (SELECT path AS route, unnest({tok('path')}) AS t FROM routes)
        SELECT DISTINCT path, route FROM a JOIN b USING (t)""",
    "jn17_relevance_sample": f"""WITH {_REQ}, s AS (SELECT p.path, r.path AS route, r.route_ord,
        len(list_intersect(list_filter(string_split(p.path, '/'), lambda x: x <> ''), list_filter(string_split(r.path, '/'), lambda x: x <> '')))
        + CASE WHEN string_split(p.path, '/')[2] = string_split(r.path, '/')[2] THEN 10 ELSE 0 END AS score FROM (SELECT DISTINCT path FROM req) p, routes r),
        k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, route_ord) AS rank FROM s) SELECT path, route, score, rank FROM k WHERE rank <= 5""",
    "win03_suggestions": f"{_SCORED} SELECT path, route, rank FROM ranked WHERE confidence >= 0.6 AND rank <= 3",
    "agg17_combined_scores": f"""WITH {_REQ}, t AS (SELECT path, matched, {tok('path')} AS x, {tok('matched')} AS y, {_GRAM.format('path')} AS gx, {_GRAM.format('matched')} AS gy FROM prs)
        SELECT path, matched, round((({_JAC}) * 0.5::DOUBLE + (1 - levenshtein(path, matched)::DOUBLE / greatest(length(path), length(matched))) * 0.2::DOUBLE + ({_DICE}) * 0.4::DOUBLE) / 1.1::DOUBLE, 6) AS score FROM t""",
    "gr06_inverted_index": f"SELECT token, string_agg(route, ',' ORDER BY route) AS routes FROM (SELECT DISTINCT unnest({tok('path')}) AS token, path AS route FROM routes) GROUP BY token",
    "stm03_learned_aliases": f"WITH {_ALIAS} SELECT from_path, to_path, learned_at FROM al",
    "stm05_resolve": f"""{_SCORED}, {_ALIAS},
        y AS (SELECT delivery_id, path, {_EXCL} AS out, x.path2 IS NOT NULL AS exact, CASE WHEN learned_at < delivery_id THEN to_path END AS to_path, best.route AS route, best.confidence AS confidence
            FROM req LEFT JOIN (SELECT path AS path2 FROM routes) x ON path = path2 LEFT JOIN al ON path = from_path LEFT JOIN best USING (path))
        SELECT delivery_id, path, CASE WHEN out THEN 'excluded' WHEN exact THEN 'exact' WHEN to_path IS NOT NULL THEN 'alias' WHEN route IS NOT NULL THEN 'semantic' ELSE 'none' END AS method,
        CASE WHEN out THEN NULL WHEN exact THEN path WHEN to_path IS NOT NULL THEN to_path ELSE route END AS route,
        CASE WHEN out THEN 0.0 WHEN exact OR to_path IS NOT NULL THEN 1.0 ELSE coalesce(confidence, 0.0) END AS confidence FROM y""",
}
QUERIES = {f.__name__: f for f in (
    flt01_excluded, str01_tokens, str02_joined_tokens, str03_semantic_tokens, str04_token_overlap, str05_levenshtein, str06_jaro_winkler, str07_soundex, str08_ngram_similarity,
    str09_cosine_similarity, str11_path_similarity, str12_synonym_group, str13_without_words, str15_url_path, str16_url_domain, str17_content_hash, str18_topic_hash,
    flt12_same_semantics, flt13_soundex_match, jn01_exact_routes, jn02_alias_targets, jn03_best_match, jn04_rank_routes, jn05_batch_matches, jn06_candidate_routes,
    jn17_relevance_sample, win03_suggestions, agg17_combined_scores, gr06_inverted_index, stm03_learned_aliases, stm05_resolve)}
