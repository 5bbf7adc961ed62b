"""Queries on domain names, kinds of pages and weighted phrases, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import authority as A
from tidewright.lexicons import domains as D, pages as G, words as L
from tidewright.plans.content import _T, _WC, docs, lit
from tidewright.plans.problems import read

PHRASES = A.phrase_list(industries=["saas", "ecommerce", "finance", "health"])
EXTRA = ["blog.github.com", "user12.github.com", "pages.medium.com", "averyveryverylongname.reddit.com", "x.com", "zoom.com", "best-deals-4-you-now.xyz", "company2024.io", "aaaab.de", "queueing.ac.uk", "strngth.net", "cloud.dev", "a.gov"]


def names(spark, sf):
    d = read(spark, sf, "discovered_citations").where("source_domain is not null").select(F.col("source_domain").alias("domain"))
    made = read(spark, sf, "routes").select(F.concat(F.regexp_replace(F.substring("path", 2, 40), "[/_]", ""), F.element_at(F.array(*[F.lit(x) for x in (".com", ".org", ".io", ".co.uk", ".xyz", ".nowhere")]), F.col("route_ord") % 6 + 1)).alias("domain"))
    return d.unionByName(made).distinct().unionByName(spark.createDataFrame([(x,) for x in EXTRA], "domain string"))


def aut01_heuristic_authority(spark, sf):
    return names(spark, sf).select("domain", A.heuristic_authority(F.col("domain")).alias("score"))


def jn12_known_domains(spark, sf):
    return names(spark, sf).select("domain", A.heuristic_authority(F.col("domain"), L.DOMAIN_AUTHORITY).alias("score"))


def ent02_page_kinds(spark, sf):
    return docs(spark, sf).select("doc_id", *[c.alias(k) for k, c in A.page_kinds(F.col("t")).items()])


def flt11_negated_keyword(spark, sf):
    t = F.col("t")
    return docs(spark, sf).select("doc_id", A.is_negated(t, "export").alias("negated"), A.is_compared(t, "export").alias("compared"))


def txt16_weighted_phrases(spark, sf):
    d = docs(spark, sf).withColumn("f", A.weighted_phrases(F.col("t"), PHRASES))
    return d.select("doc_id", A.weighted_fluff(F.col("f"), F.col("t")).alias("score"), F.array_join(F.transform("f", lambda s: F.concat(s["phrase"], F.lit(":"), s["n"].cast("string"))), ",").alias("phrases"))


_NAMES = f"""nm AS (SELECT source_domain AS domain FROM discovered_citations WHERE source_domain IS NOT NULL UNION SELECT regexp_replace(substr(path, 2, 40), '[/_]', '', 'g') || ['.com', '.org', '.io', '.co.uk', '.xyz', '.nowhere'][route_ord % 6 + 1] FROM routes
    UNION ALL SELECT unnest([{', '.join(lit(x) for x in EXTRA)}])),
p0 AS (SELECT domain, regexp_replace(lower(domain), '^www\\.', '') AS d FROM nm), p1 AS (SELECT *, string_split(d, '.') AS ps FROM p0), p AS (SELECT *, ps[1] AS n, array_to_string(ps[2:], '.') AS e, ps[-1] AS z FROM p1)"""
_END = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.ENDING_SCORES.items()) + " END"
_LISTED = f"n IN ({', '.join(lit(w) for w in D.DICTIONARY_WORDS)})"
_V, _DIG, _HY = ("length(regexp_replace(n, '[^aeiou]', '', 'g'))", "length(regexp_replace(n, '[^0-9]', '', 'g'))", "length(regexp_replace(n, '[^-]', '', 'g'))")
_TRIPLE = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz0123456789") + "|---"
_HEUR = f"""greatest(10, least(100, coalesce({_END('e')}, {_END('z')}, {D.ENDING_DEFAULT})
    + CASE WHEN length(n) <= 3 THEN 20 WHEN length(n) <= 5 THEN 15 WHEN length(n) <= 7 THEN 10 WHEN length(n) <= 10 THEN 5 ELSE 0 END
    + CASE WHEN NOT regexp_matches(n, '^[a-z]+$') THEN 0 WHEN {_LISTED} THEN 15 WHEN length(n) BETWEEN 4 AND 10 THEN 8 ELSE 0 END + CASE WHEN regexp_matches(n, '^[a-z]{{3,6}}$') THEN 5 ELSE 0 END
    + CASE WHEN regexp_matches(n, '^[a-z]{{6,12}}$') AND NOT {_LISTED} AND {_V} >= 2 AND length(n) - {_V} >= 3 AND {_V} / length(n) > 0.25 THEN 5 ELSE 0 END
    + CASE WHEN e = 'com' AND length(n) <= 6 AND regexp_matches(n, '^[a-z]+$') THEN 10 ELSE 0 END
    - CASE WHEN {_DIG} = 0 THEN 0 WHEN regexp_matches(n, '[0-9]{{4}}$') AND length(n) > 6 THEN 5 WHEN {_DIG} > 2 THEN 25 ELSE 15 END
    - CASE WHEN {_HY} = 0 THEN 0 WHEN {_HY} = 1 AND length(n) <= 15 THEN 5 WHEN {_HY} > 2 THEN 25 ELSE 10 END
    - CASE WHEN length(n) > 25 THEN 20 WHEN length(n) > 20 THEN 15 WHEN length(n) > 15 THEN 8 ELSE 0 END
    - CASE WHEN regexp_matches(n, '{D.SUSPICIOUS_START}') THEN 12 ELSE 0 END - CASE WHEN regexp_matches(n, '{D.SUSPICIOUS_END}') THEN 8 ELSE 0 END
    - CASE WHEN regexp_matches(n, '[bcdfghjklmnpqrstvwxyz]{{5,}}') THEN 15 ELSE 0 END - CASE WHEN regexp_matches(n, '[aeiou]{{4,}}') THEN 10 ELSE 0 END - CASE WHEN regexp_matches(n, '{_TRIPLE}') THEN 10 ELSE 0 END))"""
_SUBS = f"({', '.join(lit(w) for w in D.OFFICIAL_SUBDOMAINS)})"
_KNOWN = "CASE " + " ".join(f"WHEN d = '{k}' THEN {s}" for k, s in L.DOMAIN_AUTHORITY) + " " + " ".join(
    f"WHEN ends_with(d, '.{k}') THEN CASE WHEN left(d, length(d) - {len(k) + 1}) IN {_SUBS} THEN {max(s - 5, 60)} WHEN length(d) - {len(k) + 1} > 15 OR regexp_matches(left(d, length(d) - {len(k) + 1}), '[0-9]') THEN {max(s - 20, 40)} ELSE {max(s - 10, 50)} END"
    for k, s in L.DOMAIN_AUTHORITY) + f" ELSE {_HEUR} END"


def _kind_sql(kind):
    return " + ".join(f"regexp_matches(t, {lit(('(?' + f + ')' if f else '') + p)})::INT" for p, f in G.PAGE_PATTERNS[kind]) + f" AS {kind}"


def _ctx(chars, patterns):
    hit = " OR ".join(f"regexp_matches(s, {lit(p)})" for p in patterns)
    return f"len(list_filter(list_transform(range(1, len(ps)), lambda i: right(array_to_string(ps[1:i], 'export'), {chars})), lambda s: {hit})) > 0"


_CNT = "(length(lower(t)) - length(replace(lower(t), {0}, ''))) // {1}"
_FOUND = "list_filter([" + ", ".join(f"{{'impact': -{w}::DOUBLE * ({_CNT.format(lit(p), len(p))}), 'phrase': {lit(p)}, 'weight': {w}::DOUBLE, 'n': {_CNT.format(lit(p), len(p))}}}" for p, w, _ in PHRASES) + "], lambda s: s.n > 0)"
ORACLES = {
    "aut01_heuristic_authority": f"WITH {_NAMES} SELECT domain, {_HEUR} AS score FROM p",
    "jn12_known_domains": f"WITH {_NAMES} SELECT domain, {_KNOWN} AS score FROM p",
    "ent02_page_kinds": f"WITH {_T} SELECT doc_id, {', '.join(_kind_sql(k) for k in G.PAGE_PATTERNS)} FROM d",
    "flt11_negated_keyword": f"WITH {_T}, e AS (SELECT doc_id, string_split(lower(t), 'export') AS ps FROM d) SELECT doc_id, {_ctx(50, G.NEGATIONS)} AS negated, {_ctx(30, G.COMPARISONS)} AS compared FROM e",
    "txt16_weighted_phrases": f"""WITH {_T}, e AS (SELECT doc_id, list_sort({_FOUND}) AS f, {_WC.format('t')} AS w FROM d)
        SELECT doc_id, CASE WHEN len(f) = 0 OR w = 0 THEN 0 ELSE least(100, floor(round(100.0::DOUBLE * list_sum(list_transform(f, lambda s: s.n * len(string_split(s.phrase, ' ')))) / w * 0.6::DOUBLE
        + 100.0::DOUBLE * list_sum(list_transform(f, lambda s: s.n * s.weight)) / len(f) * 0.4::DOUBLE, 9) + 0.5)) END::BIGINT AS score, array_to_string(list_transform(f, lambda s: s.phrase || ':' || s.n), ',') AS phrases FROM e""",
}
QUERIES = {f.__name__: f for f in (aut01_heuristic_authority, jn12_known_domains, ent02_page_kinds, flt11_negated_keyword, txt16_weighted_phrases)}
