"""Queries on what pages are about, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import entities as E
from tidewright.functions.paths import js_round
from tidewright.lexicons import entities as L, pages as D
from tidewright.plans.content import _T, docs, lit
from tidewright.plans.problems import read


def found(spark, sf):
    return E.with_entities(docs(spark, sf), "t")


def ent01_entities(spark, sf):
    e = found(spark, sf).select("doc_id", F.posexplode("entities").alias("rank", "e"))
    return e.select("doc_id", "rank", "e.type", "e.name", "e.description", F.round("e.confidence", 4).alias("confidence"))


def ent04_properties(spark, sf):
    e = found(spark, sf).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.type", F.explode("e.properties").alias("property", "value"))
    return e.where("property <> 'mainEntity'")


def ent05_schema_graphs(spark, sf):
    """Each page's graph, read back: the things in it in order."""
    d = found(spark, sf).select("doc_id", E.schema_graph(F.col("entities")).alias("document"))
    things = F.from_json(F.get_json_object("document", "$['@graph']"), "array<struct<`@type`:string,`@id`:string,name:string,headline:string>>")
    d = d.select("doc_id", E.valid_jsonld(F.col("document")).alias("valid"), F.posexplode_outer(things).alias("place", "x"))
    return d.select("doc_id", "valid", "place", F.col("x.@type").alias("type"), F.col("x.@id").alias("id"), "x.name", "x.headline")


def ent06_trust_signals(spark, sf):
    """What articles and pages say of their making, after site and time were added."""
    d = read(spark, sf, "documents").select("doc_id", "site", F.to_date("last_modified").cast("string").alias("changed"))
    d = found(spark, sf).select("doc_id", E.schema_graph(F.col("entities")).alias("document")).join(d, "doc_id")
    d = d.select("doc_id", E.with_trust_signals(F.col("document"), publisher=F.col("site"), date_modified=F.col("changed")).alias("document"))
    x = F.from_json(F.get_json_object("document", "$['@graph']"), "array<struct<`@type`:string,dateModified:string,publisher:struct<name:string>>>")
    d = d.select("doc_id", F.posexplode(x).alias("place", "x"))
    return d.select("doc_id", "place", F.col("x.@type").alias("type"), F.col("x.dateModified").alias("changed"), F.col("x.publisher.name").alias("publisher"))


def ent07_how_to(spark, sf):
    """The steps of each page in the structured data of its instructions."""
    d = docs(spark, sf).select("doc_id", "t", E.how_to_steps(F.col("t")).alias("s")).where("size(s) > 0")
    d = d.select("doc_id", E.how_to(F.coalesce(E.page_title(F.col("t")), F.lit("HowTo")), F.col("s")).alias("document"))
    x = F.from_json("document", "struct<`@type`:string,name:string,step:array<struct<position:int,name:string>>>")
    return d.select("doc_id", F.explode(x["step"]).alias("s")).select("doc_id", "s.position", "s.name")


def ent08_round_trip(spark, sf):
    """Documents that read back as what they were made of: type, name and description of every thing."""
    d = found(spark, sf).select("doc_id", "entities", E.schema_graph(F.col("entities")).alias("document"))
    back = F.from_json(F.get_json_object("document", "$['@graph']"), "array<struct<`@type`:string,name:string,description:string>>")
    d = d.select("doc_id", F.size("entities").alias("entities"), F.filter(back, lambda x: x["@type"] != "WebPage").alias("b"), F.transform("entities", lambda e: F.struct(e["type"].alias("x"), e["name"].alias("y"), F.nullif(e["description"], F.lit("")).alias("z"))).alias("a"))
    same = F.forall(F.arrays_zip(F.col("a").alias("a"), F.col("b").alias("b")), lambda z: (z["a"]["x"] == z["b"]["@type"]) & (z["a"]["y"] == z["b"]["name"]) & z["a"]["z"].eqNullSafe(z["b"]["description"])) & (F.size("a") == F.size("b"))
    return d.select("doc_id", "entities", same.alias("same"))


def agg12_schema_coverage(spark, sf):
    """Share of pages with an entity."""
    d = found(spark, sf).select(F.size("entities").alias("n"))
    return d.agg(F.count("*").alias("pages"), F.sum((F.col("n") > 0).cast("int")).alias("with_entity"), js_round(F.avg((F.col("n") > 0).cast("int")) * 100, 0).alias("percent"))


# ---------------------------------------------------------------- SQL
def _hit(p, flags=""):
    return f"regexp_matches(t, {lit('(?' + flags + ')' + p if flags else p)})"


def _hits(signs):
    return " + ".join(f"{_hit(*s)}::INT" for s in signs) or "0"


def _context(k, chars, patterns):
    ps = f"string_split(lower(t), {lit(k)})"
    any_of = "|".join(f"(?:{p})" for p in patterns)
    return f"len(list_filter(list_transform(range(1, len({ps})), lambda i: right(array_to_string({ps}[1:i], {lit(k)}), {chars})), lambda s: regexp_matches(s, {lit(any_of)}))) > 0"


def _word(k):
    return f"CASE WHEN NOT contains(lower(t), {lit(k)}) THEN 0 WHEN {_context(k, 50, D.NEGATIONS)} THEN -2.5 WHEN {_context(k, 30, D.COMPARISONS)} THEN 0.15 ELSE 0.5 END"


def _sure(t):
    w, (words, plain) = L.WEIGHTS, L.SIGNS[t]
    kind = f"k_{L.KIND_OF.get(t, 'landing')}"
    rival = " OR ".join(f"s_{o} >= 2" for o in L.YIELDS_TO.get(t, ())) or "false"
    base = f"({w['strong']} * s_{t} + {w['against']} * a_{t} + {w['pattern']} * p_{t} + CASE WHEN s_{t} < 2 AND ({rival}) THEN {w['context']} ELSE 0 END)"
    page = f"CASE WHEN {kind} > 0 THEN 2 * {kind} WHEN greatest({', '.join('k_' + k for k in D.PAGE_PATTERNS)}) >= 3 THEN {w['context']} / 2.0 ELSE 0 END"
    most = len(L.STRONG.get(t, ())) * w["strong"] + len(plain) * w["pattern"] + min(3, len(words)) * w["keyword"]
    x = f"greatest(({base} + CASE WHEN s_{t} > 0 OR {base} > 0 THEN w_{t} ELSE 0 END + {page})::DOUBLE / {most}, 0)"
    x = f"CASE WHEN s_{t} > 0 THEN least({x} + {list(E.ADDED)}[least(s_{t}, 3) + 1]::DOUBLE, 1) ELSE {x} END"
    x = f"greatest({x} - {list(E.TAKEN)}[least(a_{t}, 3) + 1]::DOUBLE * {list(E.LEFT)}[least(s_{t}, 2) + 1]::DOUBLE, 0)"
    if t in ("Product", "Article"):
        x = f"CASE WHEN y_{t} THEN greatest({x}, 0.6) WHEN s_{t} = 0 THEN least({x}, 0.3) ELSE {x} END"
    return f"round({x}, 6)"


_P, _A, _F = L.STRONG["Product"], L.STRONG["Article"], L.STRONG["FAQ"]
_TITLE = r"coalesce(CASE WHEN regexp_matches(t, '(?m)^#\s+(.+)$') THEN regexp_extract(t, '(?m)^#\s+(.+)$', 1) END, CASE WHEN regexp_matches(t, '(?i)<h1[^>]*>([^<]+)</h1>') THEN regexp_extract(t, '(?i)<h1[^>]*>([^<]+)</h1>', 1) END)"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PRODUCT = r"CASE WHEN x.type = 'Product' AND regexp_matches(t, '(?i)(?:product|item):\s*(.+)') THEN " + _STRIP.format(r"regexp_extract(t, '(?i)(?:product|item):\s*(.+)', 1)") + " END"
_PERSON = r"CASE WHEN x.type = 'Person' AND regexp_matches(t, '(?:name|by):\s*([A-Z][a-z]+\s+[A-Z][a-z]+)') THEN regexp_extract(t, '(?:name|by):\s*([A-Z][a-z]+\s+[A-Z][a-z]+)', 1) END"
_LINE = r"(?m)^(?:[^#<|\-\n].{49,199}|<[^h\n].{48,198})"
_DESCRIPTION = f"CASE WHEN regexp_matches(t, '{_LINE}') THEN {_STRIP.format(f"regexp_extract(t, '{_LINE}')")} ELSE substr({_STRIP.format(r"regexp_replace(t, '[#*_\[\]]', '', 'g')")}, 1, 160) END"
_FOUND = f"""{_T}, n AS (SELECT doc_id, t, {', '.join(f"{_hits(L.STRONG.get(x, ()))} AS s_{x}, {_hits(p)} AS p_{x}, {_hits([(a, 'i') for a in L.AGAINST.get(x, ())])} AS a_{x}, {' + '.join(map(_word, w))} AS w_{x}" for x, (w, p) in L.SIGNS.items())},
    {', '.join(f"{_hits(p)} AS k_{k}" for k, p in D.PAGE_PATTERNS.items())}, {_hit(E.PRICE)} AND ({_hit(*_P[0])} OR {_hit(*_P[1])} OR {_hit(*_P[3])}) AS y_Product, {_hit(*_A[1])} AND {_hit(*_A[2])} AS y_Article, {_hit(*_F[0])} AND {_hit(*_F[1])} AS y_FAQ FROM d),
f AS (SELECT doc_id, t, list_sort(list_filter([{', '.join(f"{{'less': -({_sure(x)}), 'place': {i}, 'type': '{x}'}}" for i, x in enumerate(L.SIGNS))}], lambda e: e.less <= -0.45)) AS l FROM n WHERE length(t) >= 100 OR y_Product OR y_Article OR y_FAQ),
g AS (SELECT doc_id, t, CASE WHEN len(l) > 1 AND l[1].less <= -0.6 THEN list_filter(l, lambda e: NOT list_contains(map {{{', '.join(f"'{x}': {list(L.DRIVES_OUT.get(x, ())) or '[]::VARCHAR[]'}" for x in L.SIGNS)}}}[l[1].type], e.type)) ELSE l[1:2] END AS l FROM f),
e AS (SELECT doc_id, rank::INT AS rank, x.type AS type, coalesce({_STRIP.format(_TITLE)}, {_PRODUCT}, {_PERSON}, x.type) AS name, {_DESCRIPTION} AS description, round(-x.less, 4)::DOUBLE AS confidence, t FROM (SELECT doc_id, t, unnest(l) AS x, unnest(range(len(l))) AS rank FROM g))"""
_AVAIL = r"CASE WHEN regexp_matches(t, '(?i)in\s+stock') THEN 'https://schema.org/InStock' WHEN regexp_matches(t, '(?i)out\s+of\s+stock') THEN 'https://schema.org/OutOfStock' END"
_DATE = r"(?i)(?:published|posted)\s+(?:on\s+)?(\w+\s+\d+,?\s+\d{4}|\d{4}-\d{2}-\d{2})"
_SCHEMA = f"""{_FOUND}, q AS (SELECT doc_id, list(struct_pack(type := type, name := name) ORDER BY rank) AS l FROM e GROUP BY doc_id),
    x AS (SELECT d.doc_id, list_concat(CASE WHEN len(l) > 0 THEN [{{'type': 'WebPage', 'id': '#webpage', 'name': l[1].name, 'headline': NULL::VARCHAR}}] END,
        list_transform(l, lambda e: {{'type': e.type, 'id': '#' || lower(e.type), 'name': e.name, 'headline': CASE WHEN e.type = 'Article' THEN e.name END}})) AS g FROM d LEFT JOIN q USING (doc_id)),
    things AS (SELECT doc_id, true AS valid, (unnest(range(len(g))))::INT AS place, unnest(g) AS y FROM x WHERE len(g) > 0)"""
ORACLES = {
    "ent01_entities": f"WITH {_FOUND} SELECT doc_id, rank, type, name, description, confidence FROM e",
    "ent04_properties": f"""WITH {_FOUND}, p AS (SELECT doc_id, type, unnest([{{'k': 'price', 'v': CASE WHEN type = 'Product' AND {_hit(E.PRICE)} THEN regexp_replace(regexp_extract(t, {lit(E.PRICE)}), '[$,]', '', 'g') END}},
        {{'k': 'priceCurrency', 'v': CASE WHEN type = 'Product' AND {_hit(E.PRICE)} THEN 'USD' END}}, {{'k': 'availability', 'v': CASE WHEN type = 'Product' THEN {_AVAIL} END}},
        {{'k': 'datePublished', 'v': CASE WHEN type = 'Article' AND {_hit(_DATE)} THEN regexp_extract(t, {lit(_DATE)}, 1) END}}, {{'k': 'author', 'v': CASE WHEN type = 'Article' AND {_hit('by\\s+([A-Z][a-z]+\\s+[A-Z][a-z]+)')} THEN regexp_extract(t, 'by\\s+([A-Z][a-z]+\\s+[A-Z][a-z]+)', 1) END}},
        {{'k': 'foundingDate', 'v': CASE WHEN type = 'Organization' AND {_hit('(?i)founded\\s+(?:in\\s+)?(\\d{4})')} THEN regexp_extract(t, '(?i)founded\\s+(?:in\\s+)?(\\d{{4}})', 1) END}}]) AS x FROM e) SELECT doc_id, type, x.k AS property, x.v AS value FROM p WHERE x.v IS NOT NULL""",
    "ent05_schema_graphs": f"WITH {_SCHEMA} SELECT doc_id, valid, place, y.type AS type, y.id AS id, y.name AS name, y.headline AS headline FROM things UNION ALL SELECT doc_id, false, NULL, NULL, NULL, NULL, NULL FROM x WHERE g IS NULL OR len(g) = 0",
    "ent06_trust_signals": f"""WITH {_SCHEMA} SELECT things.doc_id, place, y.type AS type, CASE WHEN y.type IN ('Article', 'WebPage') THEN strftime(last_modified, '%Y-%m-%d') END AS changed, CASE WHEN y.type = 'Article' THEN site END AS publisher FROM things JOIN documents USING (doc_id)""",
    "ent08_round_trip": f"WITH {_FOUND} SELECT d.doc_id, count(e.doc_id)::INT AS entities, true AS same FROM d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id",
    "agg12_schema_coverage": f"WITH {_FOUND}, c AS (SELECT d.doc_id, count(e.doc_id) > 0 AS h FROM d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id) SELECT count(*) AS pages, sum(h::INT)::BIGINT AS with_entity, floor(avg(h::INT) * 100 + 0.5)::BIGINT AS percent FROM c",
}
QUERIES = {f.__name__: f for f in (ent01_entities, ent04_properties, ent05_schema_graphs, ent06_trust_signals, ent07_how_to, ent08_round_trip, agg12_schema_coverage)}
