"""Queries on questions, steps, items and query variations, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import extract as X
from tidewright.functions.entities import page_title
from tidewright.functions.structure import word_count
from tidewright.lexicons import words as L
from tidewright.plans.content import _T, _WC, docs, lit, win08_featured_paragraph
from tidewright.plans.problems import read


def txt13_pyramid(spark, sf):
    d = docs(spark, sf).select("doc_id", word_count(F.col("t")).alias("words"), X.answer_position(F.col("t")).alias("position"))
    return d.select("doc_id", "position", X.pyramid_score(F.col("position"), F.col("words")).alias("score"), ((F.col("position") <= 100) & (F.col("words") > 0)).alias("optimal"))


def txt23_faq(spark, sf):
    p = docs(spark, sf).select("doc_id", F.posexplode(X.faq_pairs(F.col("t"))).alias("pos", "p"))
    return p.select("doc_id", "pos", "p.question", "p.answer")


def txt24_steps(spark, sf):
    """The steps of each text in order, with the title that instructions made of them would have."""
    d = docs(spark, sf).select("doc_id", "t", X.steps(F.col("t")).alias("s")).where(F.size("s") > 0)
    return d.select("doc_id", F.coalesce(page_title(F.col("t")), F.lit("How To")).alias("title"), F.posexplode("s").alias("place", "x")).select("doc_id", "title", "place", "x.position", "x.text")


def txt25_readiness(spark, sf):
    """35 for questions, 35 for steps, 30 for a featured paragraph of at most 50 words, else 15."""
    t = F.col("t")
    d = docs(spark, sf).select("doc_id", F.size(X.faq_pairs(t)).alias("faq"), F.size(X.steps(t)).alias("steps"))
    d = d.join(win08_featured_paragraph(spark, sf).select("doc_id", "words"), "doc_id", "left")
    best = F.when(F.col("words").isNull(), 0).when(F.col("words") <= 50, 30).otherwise(15)
    return d.select("doc_id", (F.when(F.col("faq") > 0, 35).otherwise(0) + F.when(F.col("steps") > 0, 35).otherwise(0) + best).alias("score"))


def _items(spark, sf):
    return docs(spark, sf).select("doc_id", "t", X.list_items(F.col("t")).alias("i"))


def txt31_items(spark, sf):
    d = _items(spark, sf).select("doc_id", F.posexplode("i").alias("pos", "i"))
    facts = F.array_join(F.array_sort(F.transform(F.map_entries("i.attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return d.select("doc_id", "pos", "i.title", "i.description", facts.alias("attributes"))


def txt32_comparison_tables(spark, sf):
    return docs(spark, sf).select("doc_id", X.comparison_table(F.col("t")).alias("comparison"))


def txt33_faq_pages(spark, sf):
    d = docs(spark, sf).select("doc_id", X.faq_page(F.col("t")).alias("p"))
    return d.select("doc_id", F.col("p.items").alias("items"), F.round("p.confidence", 6).alias("confidence"), F.length("p.transformed").alias("chars"))


def txt35_top_lists(spark, sf):
    return _items(spark, sf).select("doc_id", X.top_n_list(F.col("i"), F.col("t"), 5).alias("list"), X.roundup(F.col("i"), F.col("t")).alias("roundup"), F.least(F.size("i") / 5, F.lit(1.0)).alias("confidence"))


def txt36_sub_queries(spark, sf):
    q = read(spark, sf, "reddit_posts").select(F.col("title").alias("query")).where("title is not null").distinct()
    return q.select("query", X.query_intent(F.col("query")).alias("intent"), *[F.array_join(X.sub_queries(F.col("query"), e[0]), "|").alias(e[0]) for e in L.ENGINES])


def txt37_domain_overlap(spark, sf):
    """Of each two source kinds the overlap of their domains."""
    d = read(spark, sf, "discovered_citations").where("source_domain is not null").select("source_kind", F.lower("source_domain").alias("d")).distinct()
    n = d.groupBy("source_kind").agg(F.count("*").alias("n"))
    met = d.select(F.col("source_kind").alias("a"), "d").join(d.select(F.col("source_kind").alias("b"), "d"), "d").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    kinds = n.select(F.col("source_kind").alias("a"), F.col("n").alias("an")).join(n.select(F.col("source_kind").alias("b"), F.col("n").alias("bn")), F.col("a") < F.col("b"))
    c = F.coalesce("c", F.lit(0))
    return kinds.join(met, ["a", "b"], "left").select("a", "b", (F.floor(c / (F.col("an") + F.col("bn") - c) * 100 + 0.5) / 100).alias("overlap"))


def txt38_engine_advice(spark, sf):
    """Which of three remarks an engine makes on the citations of a kind: no earned media, no lists, old."""
    m = read(spark, sf, "discovered_citations").groupBy("source_kind").agg(F.max(F.col("is_earned_media").cast("int")).alias("earned"), F.max("discovered_at").alias("last"))
    engines = spark.createDataFrame([e[:4] for e in L.ENGINES], "engine string, earned_weight double, list_weight double, fresh_weight double")
    old = F.col("last") < F.lit("2020-02-01").cast("timestamp")
    c = F.col
    advice = F.array_compact(F.array(F.when((c("earned") == 0) & (c("earned_weight") > 0.7), "earned"), F.when(c("list_weight") > 0.7, "list"), F.when(old & (c("fresh_weight") > 0.7), "fresh")))
    return m.crossJoin(F.broadcast(engines)).select("source_kind", "engine", F.array_join(advice, ",").alias("advice"))


from tidewright.plans.entities import _STRIP, _TITLE  # noqa: E402

_KEY = "(?i)" + "|".join(L.KEY_INDICATORS)
_MAIN = f"coalesce(nullif(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(lit(w) for w in L.QUERY_STOP_WORDS)})), ' '), ''), query)"
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(query, {lit('(?i)' + p)}) THEN '{n}'" for n, p in L.QUERY_INTENTS) + " ELSE 'general' END"


def _sql_list(ts):
    return "[" + ", ".join(f"replace({lit(t)}, '@', main)" for t in ts) + "]"


def _sql_sub(engine, least, most):
    more = "CASE intent " + " ".join(f"WHEN '{n}' THEN {_sql_list(ts)}" for n, ts in L.QUERY_VARIATIONS.items()) + " END"
    every = f"list_concat([query], {more}" + (f", {_sql_list(L.ENGINE_VARIATIONS[engine])}" if engine in L.ENGINE_VARIATIONS else "") + ")"
    once = f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"
    return f"array_to_string(list_slice({once}, 1, least({most}, greatest({least}, len({once})))), '|') AS {engine}"


ORACLES = {
    "txt13_pyramid": f"""WITH {_T}, w AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''), ' ') AS s, {_WC.format('t')} AS n FROM d),
        b AS (SELECT doc_id, n, s, regexp_matches(s, {lit(_KEY)}) AS hit, regexp_replace(s, {lit('(?s)(?:' + _KEY + ').*')}, '') AS pre, regexp_extract(s, {lit(_KEY)}, 0) AS m FROM w),
        p AS (SELECT doc_id, n, CASE WHEN hit THEN greatest(length(pre) - length(replace(pre, ' ', '')) + CASE WHEN contains(m, ' ') THEN 1 ELSE 0 END - 2, 0) ELSE n // 2 END AS position FROM b)
        SELECT doc_id, position, CASE WHEN n = 0 THEN 0 ELSE floor(round(CASE WHEN position <= 50 THEN 100.0 WHEN position <= 100 THEN 100 - (position - 50) * 0.4 WHEN position <= 200 THEN 80 - (position - 100) * 0.3
        ELSE greatest(0.0, 50 - (position - 200) * 0.1) END::DOUBLE, 9) + 0.5)::BIGINT END AS score, position <= 100 AND n > 0 AS optimal FROM p""",
    "txt24_steps": f"""WITH {_T}, a AS (SELECT doc_id, t, regexp_extract_all(t, '(?im)^Step\\s+(\\d+):\\s*(.+)', 1) AS x, regexp_extract_all(t, '(?im)^Step\\s+(\\d+):\\s*(.+)', 2) AS xt,
        regexp_extract_all(t, '(?m)^(\\d+)\\.\\s+(.+)', 1) AS y, regexp_extract_all(t, '(?m)^(\\d+)\\.\\s+(.+)', 2) AS yt FROM d),
        b AS (SELECT doc_id, t, CASE WHEN len(x) > 0 THEN list_transform(x, lambda n, i: {{'p': TRY_CAST(n AS BIGINT), 'i': i, 't': xt[i]}}) ELSE list_transform(y, lambda n, i: {{'p': TRY_CAST(n AS BIGINT), 'i': i, 't': yt[i]}}) END AS z FROM a),
        c AS (SELECT doc_id, t, unnest(z) AS s FROM b WHERE len(z) > 0)
        SELECT doc_id, coalesce({_STRIP.format(_TITLE)}, 'How To') AS title, (row_number() OVER (PARTITION BY doc_id ORDER BY s.p NULLS FIRST, s.i) - 1)::INT AS place, s.p AS position, {_STRIP.format('s.t')} AS text FROM c""",
    "txt36_sub_queries": f"WITH q AS (SELECT DISTINCT title AS query FROM reddit_posts WHERE title IS NOT NULL), m AS (SELECT query, {_MAIN} AS main, {_INTENT} AS intent FROM q) SELECT query, intent, {', '.join(_sql_sub(e[0], e[4], e[5]) for e in L.ENGINES)} FROM m",
    "txt37_domain_overlap": """WITH d AS (SELECT DISTINCT source_kind AS k, lower(source_domain) AS d FROM discovered_citations WHERE source_domain IS NOT NULL), n AS (SELECT k, list(d) AS l FROM d GROUP BY 1)
        SELECT a.k AS a, b.k AS b, floor(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))) * 100 + 0.5) / 100 AS overlap FROM n a JOIN n b ON a.k < b.k""",
    "txt38_engine_advice": f"""WITH m AS (SELECT source_kind, max(is_earned_media::INT) AS earned, max(discovered_at) AS last FROM discovered_citations GROUP BY 1), e AS (SELECT * FROM (VALUES {', '.join(str(tuple(x[:4])) for x in L.ENGINES)}) AS t(engine, ew, lw, fw))
        SELECT source_kind, engine, concat_ws(',', CASE WHEN earned = 0 AND ew > 0.7 THEN 'earned' END, CASE WHEN lw > 0.7 THEN 'list' END, CASE WHEN last < TIMESTAMPTZ '2020-02-01 00:00:00+00' AND fw > 0.7 THEN 'fresh' END) AS advice FROM m, e""",
}
QUERIES = {f.__name__: f for f in (txt13_pyramid, txt23_faq, txt24_steps, txt25_readiness, txt31_items, txt32_comparison_tables, txt33_faq_pages, txt35_top_lists, txt36_sub_queries, txt37_domain_overlap, txt38_engine_advice)}
