"""Queries on the structure and wording of documents, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewright.functions import paths as P, structure as S
from tidewright.lexicons import words as L
from tidewright.plans.problems import read
from tidewright.session import spread


def docs(spark, sf):
    return spread(read(spark, sf, "documents")).select("doc_id", S.plain_lines(F.col("text")).alias("t"))


def sents(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(S.sentences(F.col("t"))).alias("pos", "s"))


def txt01_tables(spark, sf):
    return docs(spark, sf).select("doc_id", S.tables(F.col("t")).alias("n"))


def txt02_bullet_lists(spark, sf):
    return docs(spark, sf).select("doc_id", S.bullet_lists(F.col("t")).alias("n"))


def txt03_statistics(spark, sf):
    return docs(spark, sf).select("doc_id", S.statistics(F.col("t")).alias("n"))


def txt04_header_levels(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(F.transform(S.header_levels(F.col("t")), lambda n: n.cast("string")), ",").alias("levels"))


def txt05_header_hierarchy(spark, sf):
    return docs(spark, sf).select("doc_id", S.valid_hierarchy(S.header_levels(F.col("t"))).alias("valid"))


def _density(spark, sf):
    d = docs(spark, sf).select("doc_id", *[c.alias(k) for k, c in S.breakdown(F.col("t")).items()])
    return d.withColumn("score", S.density_score(*[F.col(c) for c in ("tables", "bullet_lists", "statistics", "headers", "valid_hierarchy")]))


def txt06_density_score(spark, sf):
    return _density(spark, sf).select("doc_id", "score")


def txt07_justification(spark, sf):
    s = F.col("statistics")
    return _density(spark, sf).select("doc_id", F.when(s >= 5, "high").when(s >= 2, "medium").otherwise("low").alias("level"))


def txt08_density_advice(spark, sf):
    """Codes of what a text below half a score lacks."""
    c = F.col
    codes = F.array(F.when(c("tables") == 0, "table"), F.when(c("bullet_lists") < 2, "lists"), F.when(c("statistics") < 3, "statistics"),
                    F.when(~c("valid_hierarchy"), "hierarchy"), F.when((c("headers") < 3) & (c("score") < 0.3), "headers"))
    return _density(spark, sf).select("doc_id", F.when(c("score") >= 0.5, "").otherwise(F.array_join(F.array_compact(codes), ",")).alias("advice"))


def txt09_density(spark, sf):
    return _density(spark, sf)


def flt08_needs_improvement(spark, sf):
    return _density(spark, sf).where("score < 0.5").select("doc_id")


def agg12_mean_density(spark, sf):
    d = _density(spark, sf).join(read(spark, sf, "documents").select("doc_id", F.coalesce("site", F.lit("")).alias("site")), "doc_id")
    return d.groupBy("site").agg(F.count("*").alias("pages"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg((F.col("headers") > 0).cast("int")), 6).alias("with_headers"))


def snk16_summary(spark, sf):
    c = F.col
    return _density(spark, sf).select("doc_id", F.concat(F.lit("score "), F.format_string("%.2f", c("score")), F.lit("; tables "), c("tables"), F.lit("; lists "), c("bullet_lists"),
                                                        F.lit("; statistics "), c("statistics"), F.lit("; headers "), c("headers")).alias("summary"))


def txt11_commodity_phrases(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(S.phrases_in(F.col("t"), L.COMMODITY_PHRASES), ",").alias("phrases"))


def txt14_fluff(spark, sf):
    return docs(spark, sf).select("doc_id", S.fluff_score(F.col("t")).alias("score"))


def txt15_elements(spark, sf):
    t = F.col("t")
    return docs(spark, sf).select("doc_id", S.tables(t).alias("tables"), S.bullet_lists(t).alias("lists"), (S.count(t, S.NUMBERED, True) > 0).alias("has_numbered"),
                                  (S.count(t, S.JSON_LD) > 0).alias("has_json_ld"), S.count(t, S.PROS_CONS).alias("pros_cons"), S.count(t, S.BOLD).alias("bold"))


def txt17_sentences(spark, sf):
    return sents(spark, sf).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).alias("longest"))


def txt18_rough_sentences(spark, sf):
    x = S.rough_sentences(F.col("t"))
    return docs(spark, sf).select("doc_id", F.size(x).alias("sentences"))


def flt06_sentence_tests(spark, sf):
    s = F.col("s")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return sents(spark, sf).groupBy("doc_id").agg(n(S.has_statistic(s)).alias("statistic"), n(S.has_attribution(s)).alias("attribution"), n(S.is_specific(s)).alias("specific"),
                                                 n(F.length(s) <= 280).alias("concise"), n(S.is_unique(s)).alias("is_unique"))


def txt19_snippet_scores(spark, sf):
    return sents(spark, sf).select("doc_id", "pos", S.snippet_score(F.col("s")).alias("score"))


def win02_top_snippets(spark, sf):
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    rows = sents(spark, sf).withColumn("score", S.snippet_score(F.col("s"))).withColumn("place", F.row_number().over(w))
    return rows.where("place <= 5").select("doc_id", "pos", "score", "place")


def txt20_anchors(spark, sf):
    return sents(spark, sf).where(S.has_statistic(F.col("s")) & S.is_unique(F.col("s"))).select("doc_id", "pos", F.length("s").alias("chars"))


def txt21_citation_parts(spark, sf):
    """Unique data, attribution and snippet parts of a page's citation score."""
    t = F.col("t")
    d = docs(spark, sf).withColumn("r", S.rough_sentences(t)).withColumn("q", S.sentences(t))
    share = lambda test: F.coalesce(F.try_divide(F.size(F.filter("r", test)).cast("double"), F.size("r")), F.lit(0.0))
    best = F.slice(F.reverse(F.array_sort(F.transform("q", S.snippet_score))), 1, 5)
    top = F.coalesce(F.try_divide(F.aggregate(best, F.lit(0), lambda a, x: a + x).cast("double"), F.size(best)), F.lit(0.0))
    return d.select("doc_id", S.js_round(40 * F.least(share(S.has_statistic) / 0.2, F.lit(1.0))).alias("unique_data"),
                    S.js_round(20 * F.least(share(S.has_attribution) / 0.1, F.lit(1.0))).alias("attribution"), S.js_round(top / 100 * 20).alias("snippets"))


def agg19_ranked_pages(spark, sf):
    p = txt21_citation_parts(spark, sf).select("doc_id", (F.col("unique_data") + F.col("attribution") + F.col("snippets")).alias("total"))
    best = sents(spark, sf).groupBy("doc_id").agg(F.max_by("pos", F.struct(S.snippet_score(F.col("s")), -F.col("pos"))).alias("best_sentence"))
    return p.join(best, "doc_id", "left").select("doc_id", "total", "best_sentence")


def txt22_words_paragraphs(spark, sf):
    return docs(spark, sf).select("doc_id", S.word_count(F.col("t")).alias("words"), F.size(S.paragraphs(F.col("t"))).alias("paragraphs"))


def win08_featured_paragraph(spark, sf):
    """Of paragraphs of 10 to 100 words the one nearest to 45, the first of equals; else the first of at least 5 words; else the first."""
    p = docs(spark, sf).select("doc_id", F.posexplode(S.paragraphs(F.col("t"))).alias("pos", "p")).withColumn("n", S.word_count(F.col("p")))
    rank = F.when(F.col("n").between(10, 100), F.struct(F.lit(0).alias("k"), F.abs(F.col("n") - 45).alias("d"))).when(
        F.col("n") >= 5, F.struct(F.lit(1).alias("k"), F.lit(0).alias("d"))).otherwise(F.struct(F.lit(2).alias("k"), F.lit(0).alias("d")))
    return p.groupBy("doc_id").agg(F.min_by(F.struct("pos", "n"), F.struct(rank.alias("r"), "pos")).alias("b")).select("doc_id", "b.pos", F.col("b.n").alias("words"))


def txt26_differentiation(spark, sf):
    """Occurrences of stock phrases, their share of the words, whether that is low differentiation."""
    t = F.col("t")
    total = P.let(F.lower(t), lambda low: sum((S.occurrences_of(low, p) * len(p.split()) for p in L.DIFFERENTIATION_PHRASES), F.lit(0)))
    share = F.coalesce(F.try_divide(total.cast("double"), S.word_count(t)), F.lit(0.0))
    return docs(spark, sf).select("doc_id", total.alias("phrase_words"), F.round(share, 9).alias("share"), (share > 0.3).alias("low"))


def txt27_quick_facts(spark, sf):
    """The first 25 sentences of all pages with a statistic, between 20 and 200 characters."""
    s = F.col("s")
    rows = sents(spark, sf).where((F.length(s) > 20) & (F.length(s) < 200) & S.has_statistic(s))
    return rows.orderBy("doc_id", "pos").limit(25).select("doc_id", "pos", F.length("s").alias("chars"))


def txt28_intents(spark, sf):
    """Intents met in any page, with the first page and the number of pages."""
    d = docs(spark, sf)
    hits = F.array(*[F.when(F.col("t").rlike("(?i)" + p), name) for p, name in L.INTENTS])
    return d.select("doc_id", F.explode(F.array_compact(hits)).alias("intent")).groupBy("intent").agg(F.min("doc_id").alias("first_page"), F.count("*").alias("pages"))


def txt28_manifest_entities(spark, sf):
    d = docs(spark, sf)
    hits = F.array(*[F.when(F.col("t").rlike("(?i)" + p), name) for p, name in L.MANIFEST_ENTITIES])
    return d.select("doc_id", F.explode(F.array_compact(hits)).alias("entity_type")).groupBy("entity_type").agg(F.min("doc_id").alias("first_page"), F.count("*").alias("pages"))


def txt29_topics(spark, sf):
    x = S.topics(F.col("t"))
    return docs(spark, sf).select("doc_id", F.size(x).alias("topics"), F.array_join(F.slice(x, 1, 8), " ").alias("first_topics"))


def txt34_listicle(spark, sf):
    return docs(spark, sf).select("doc_id", *[c.alias(k) for k, c in S.listicle(F.col("t")).items()])


def flt07_question_lines(spark, sf):
    line = F.regexp_replace(F.col("l"), r"^\s+|\s+$", "")
    q = line.rlike(r"(?i)^(what|how|why|when|where|who|which|can|does|is|are|will|should)\s+.+\?") | line.rlike(r"^\*\*Q:\*\*\s*(.+)") | line.rlike(r"^Q:\s*(.+)") | line.rlike(r"(?i)^Question:\s*(.+)")
    return docs(spark, sf).select("doc_id", F.explode(F.split("t", "\n")).alias("l")).groupBy("doc_id").agg(F.sum(F.when(q, 1).otherwise(0)).alias("questions"))


def ent03_sentence_context(spark, sf):
    """Sentences that mention a keyword, per page."""
    x = F.filter(S.rough_sentences(F.col("t")), lambda s: F.contains(F.lower(s), F.lit("sitemap")))
    return docs(spark, sf).where(F.size(x) > 0).select("doc_id", F.size(x).alias("n"), F.length(F.element_at(x, 1)).alias("first_chars"))


def ent04_name(spark, sf):
    """First markdown title, else first HTML title of a page."""
    t = F.col("t")
    md = F.nullif(F.regexp_extract(t, r"(?md)^#\s+(.+)$", 1), F.lit(""))
    h = F.nullif(F.regexp_extract(t, r"(?i)<h1[^>]*>([^<]+)</h1>", 1), F.lit(""))
    return docs(spark, sf).select("doc_id", F.coalesce(md, h).alias("name"))


# ---------------------------------------------------------------- SQL twins
def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_T = r"d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents)"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SENT = f"list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_TRIM.format('s')}), lambda s: s <> '')"
_ROUGH = f"list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda s: {_TRIM.format('s')}), lambda s: s <> '')"
_PARA = f"list_filter(list_transform(regexp_split_to_array(t, '\\n\\n+'), lambda s: {_TRIM.format('s')}), lambda s: s <> '')"
_WC = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
_N = "len(regexp_extract_all(t, {0}))"


def n_of(p: str, m: bool = False) -> str:
    return _N.format(lit(("(?m)" if m else "") + p))


def any_sql(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {lit(('(?i)' if i else '') + p)})" for p, i in patterns) + ")"


_TABLES = f"CASE WHEN {n_of(S.TABLE_ROW, True)} >= 3 AND {n_of(S.TABLE_SEPARATOR, True)} >= 1 THEN {n_of(S.TABLE_SEPARATOR, True)} ELSE 0 END"
_MARKS = f"list_transform(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '\\S')), lambda s: regexp_matches(s, {lit(S.BULLET)}) OR regexp_matches(s, {lit(S.NUMBERED)}))"
_STATS = "len(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(t, {lit(p)})" for p in S.STATISTICS) + ")))"
_LEVELS = f"list_concat(list_transform(regexp_extract_all(t, {lit('(?m)' + S.MARKDOWN_HEADER)}), lambda h: length(regexp_extract(h, '^(#+)', 1))::INT), list_transform(regexp_extract_all(t, {lit(S.HTML_HEADER)}, 1), lambda h: h::INT))"
_DENS = f"""{_T}, e AS (SELECT doc_id, {_TABLES} AS tables, {_MARKS} AS mk, {_STATS} AS statistics, {_LEVELS} AS lv FROM d),
f AS (SELECT doc_id, tables, len(list_filter(mk, lambda m, i: m AND (i = 1 OR NOT mk[i - 1]))) AS bullet_lists, statistics, len(lv) AS headers,
    len(list_filter(lv, lambda l, i: i > 1 AND l > lv[i - 1] + 1)) = 0 AS valid_hierarchy FROM e),
dens AS (SELECT *, floor((0.25::DOUBLE * least(tables / 2, 1.0) + 0.2::DOUBLE * least(bullet_lists / 3, 1.0) + 0.25::DOUBLE * least(statistics / 5, 1.0) + 0.15::DOUBLE * least(headers / 4, 1.0)
    + CASE WHEN valid_hierarchy THEN 0.15 ELSE 0.0 END::DOUBLE) * 100 + 0.5) / 100 AS score FROM f)"""


def phr(c: str, listed) -> str:
    return f"list_filter([{', '.join(lit(p) for p in listed)}], lambda p: contains(lower({c}), p))"


_FLUFF = phr("t", list(dict.fromkeys(L.FLUFFY_PHRASES + L.COMMODITY_PHRASES)))
_S = f"{_T}, s AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS s FROM (SELECT doc_id, {_SENT} AS x FROM d))"
_STAT, _ATTR, _SPEC = (any_sql("s", p) for p in (L.STATISTIC_PATTERNS, L.ATTRIBUTION_PATTERNS, L.SPECIFICITY_PATTERNS))
_UNIQ = f"len({phr('s', L.DIFFERENTIATION_PHRASES)}) = 0"
_SCORE = f"(CASE WHEN {_STAT} THEN 30 ELSE 0 END + CASE WHEN {_UNIQ} THEN 25 ELSE 0 END + CASE WHEN {_SPEC} THEN 20 ELSE 0 END + CASE WHEN length(s) <= 280 THEN 15 ELSE 0 END + CASE WHEN {_ATTR} THEN 10 ELSE 0 END)"
_PARTS = f"""{_S}, sc AS (SELECT doc_id, pos, {_SCORE} AS score FROM s), tp AS (SELECT doc_id, avg(score) AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM sc) WHERE k <= 5 GROUP BY 1),
r AS (SELECT doc_id, unnest({_ROUGH}) AS s FROM d), ra AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({_STAT}) AS st, count(*) FILTER ({_ATTR}) AS atr FROM r GROUP BY 1),
parts AS (SELECT d.doc_id, floor(40 * least(coalesce(st / n, 0) / 0.2::DOUBLE, 1.0) + 0.5)::BIGINT AS unique_data, floor(20 * least(coalesce(atr / n, 0) / 0.1::DOUBLE, 1.0) + 0.5)::BIGINT AS attribution,
    floor(coalesce(top, 0) / 100 * 20 + 0.5)::BIGINT AS snippets FROM d LEFT JOIN ra USING (doc_id) LEFT JOIN tp USING (doc_id))"""
_DIFF = " + ".join(f"(length(lower(t)) - length(replace(lower(t), {lit(p)}, ''))) // {len(p)} * {len(p.split())}" for p in L.DIFFERENTIATION_PHRASES)
_TOPICS = f"list_filter(list_filter(regexp_split_to_array(regexp_replace(lower(t), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3), lambda w: w NOT IN ({', '.join(lit(w) for w in L.TOPIC_STOP_WORDS)}))"
_LIST = f"""{_T}, e AS (SELECT doc_id, t, {n_of('(?i)' + chr(92) + 'bvs' + chr(92) + '.?' + chr(92) + 'b|' + chr(92) + 'bversus' + chr(92) + 'b')} AS vs, {n_of('^' + chr(92) + 's*[-*•]' + chr(92) + 's+.+$', True)} AS b,
    {n_of('^' + chr(92) + 's*' + chr(92) + 'd+' + chr(92) + '.' + chr(92) + 's+.+$', True)} AS num, regexp_matches(t, '(?i)\\btop\\s+\\d+\\b|\\bbest\\s+\\d+\\b') AS top, {n_of(chr(92) + '?')} AS qm FROM d),
f AS (SELECT doc_id, top, round(CASE WHEN vs > 0 THEN 0.3::DOUBLE * least(vs, 3) ELSE 0 END, 9) AS c, round(CASE WHEN b >= 3 THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN num >= 3 THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN top THEN 0.2 ELSE 0 END::DOUBLE, 9) AS l,
    round(CASE WHEN qm >= 3 THEN 0.3::DOUBLE + least(qm / 20, 0.3::DOUBLE) ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)(?:Q:|Question:|FAQ)') THEN 0.3 ELSE 0 END::DOUBLE, 9) AS q FROM e),
g AS (SELECT *, greatest(c, l, q) AS m FROM f)"""


def seen(pairs, name: str) -> str:
    return f"WITH {_T} SELECT {name}, min(doc_id) AS first_page, count(*) AS pages FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS {name} FROM d WHERE regexp_matches(t, {lit('(?i)' + p)})" for p, n in pairs) + ") GROUP BY 1"


ORACLES = {
    "txt01_tables": f"WITH {_T} SELECT doc_id, {_TABLES} AS n FROM d",
    "txt02_bullet_lists": f"WITH {_DENS} SELECT doc_id, bullet_lists AS n FROM dens",
    "txt03_statistics": f"WITH {_T} SELECT doc_id, {_STATS} AS n FROM d",
    "txt04_header_levels": f"WITH {_T} SELECT doc_id, array_to_string({_LEVELS}, ',') AS levels FROM d",
    "txt05_header_hierarchy": f"WITH {_DENS} SELECT doc_id, valid_hierarchy AS valid FROM dens",
    "txt06_density_score": f"WITH {_DENS} SELECT doc_id, score FROM dens",
    "txt07_justification": f"WITH {_DENS} SELECT doc_id, CASE WHEN statistics >= 5 THEN 'high' WHEN statistics >= 2 THEN 'medium' ELSE 'low' END AS level FROM dens",
    "txt08_density_advice": f"""WITH {_DENS} SELECT doc_id, CASE WHEN score >= 0.5 THEN '' ELSE concat_ws(',', CASE WHEN tables = 0 THEN 'table' END, CASE WHEN bullet_lists < 2 THEN 'lists' END, CASE WHEN statistics < 3 THEN 'statistics' END,
        CASE WHEN NOT valid_hierarchy THEN 'hierarchy' END, CASE WHEN headers < 3 AND score < 0.3 THEN 'headers' END) END AS advice FROM dens""",
    "txt09_density": f"WITH {_DENS} SELECT * FROM dens",
    "flt08_needs_improvement": f"WITH {_DENS} SELECT doc_id FROM dens WHERE score < 0.5",
    "agg12_mean_density": f"WITH {_DENS} SELECT coalesce(site, '') AS site, count(*) AS pages, round(avg(score), 6) AS score, round(avg((headers > 0)::INT), 6) AS with_headers FROM dens JOIN documents USING (doc_id) GROUP BY 1",
    "snk16_summary": f"WITH {_DENS} SELECT doc_id, 'score ' || printf('%.2f', score) || '; tables ' || tables || '; lists ' || bullet_lists || '; statistics ' || statistics || '; headers ' || headers AS summary FROM dens",
    "txt11_commodity_phrases": f"WITH {_T} SELECT doc_id, array_to_string({phr('t', L.COMMODITY_PHRASES)}, ',') AS phrases FROM d",
    "txt14_fluff": f"""WITH {_T}, e AS (SELECT doc_id, coalesce(100.0::DOUBLE * coalesce(list_sum(list_transform({_FLUFF}, lambda p: len(string_split(p, ' ')))), 0) / nullif({_WC.format('t')}, 0), 0) AS p FROM d)
        SELECT doc_id, round(least(CASE WHEN p >= 30 THEN 70 + least(30.0, p - 30) ELSE floor(p / 30 * 70 + 0.5) END, 100.0), 6) AS score FROM e""",
    "txt15_elements": f"""WITH {_DENS} SELECT doc_id, tables, bullet_lists AS lists, {n_of(S.NUMBERED, True)} > 0 AS has_numbered, {n_of(S.JSON_LD)} > 0 AS has_json_ld, {n_of(S.PROS_CONS)} AS pros_cons, {n_of(S.BOLD)} AS bold
        FROM dens JOIN d USING (doc_id)""",
    "txt17_sentences": f"WITH {_S} SELECT doc_id, count(*) AS sentences, max(length(s)) AS longest FROM s GROUP BY 1",
    "txt18_rough_sentences": f"WITH {_T} SELECT doc_id, len({_ROUGH}) AS sentences FROM d",
    "flt06_sentence_tests": f"WITH {_S} SELECT doc_id, count(*) FILTER ({_STAT}) AS statistic, count(*) FILTER ({_ATTR}) AS attribution, count(*) FILTER ({_SPEC}) AS specific, count(*) FILTER (length(s) <= 280) AS concise, count(*) FILTER ({_UNIQ}) AS is_unique FROM s GROUP BY 1",
    "txt19_snippet_scores": f"WITH {_S} SELECT doc_id, pos, {_SCORE} AS score FROM s",
    "win02_top_snippets": f"WITH {_S} SELECT doc_id, pos, score, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place FROM (SELECT doc_id, pos, {_SCORE} AS score FROM s)) WHERE place <= 5",
    "txt20_anchors": f"WITH {_S} SELECT doc_id, pos, length(s) AS chars FROM s WHERE {_STAT} AND {_UNIQ}",
    "txt21_citation_parts": f"WITH {_PARTS} SELECT * FROM parts",
    "agg19_ranked_pages": f"WITH {_PARTS}, b AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM sc) WHERE k = 1) SELECT doc_id, unique_data + attribution + snippets AS total, pos AS best_sentence FROM parts LEFT JOIN b USING (doc_id)",
    "txt22_words_paragraphs": f"WITH {_T} SELECT doc_id, {_WC.format('t')} AS words, len({_PARA}) AS paragraphs FROM d",
    "win08_featured_paragraph": f"""WITH {_T}, p AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS p FROM (SELECT doc_id, {_PARA} AS x FROM d)), n AS (SELECT doc_id, pos, {_WC.format('p')} AS words FROM p),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN words BETWEEN 10 AND 100 THEN 0 WHEN words >= 5 THEN 1 ELSE 2 END, CASE WHEN words BETWEEN 10 AND 100 THEN abs(words - 45) ELSE 0 END, pos) AS k FROM n)
        SELECT doc_id, pos, words FROM k WHERE k = 1""",
    "txt26_differentiation": f"""WITH {_T}, e AS (SELECT doc_id, {_DIFF} AS phrase_words, {_WC.format('t')} AS w FROM d)
        SELECT doc_id, phrase_words, round(coalesce(phrase_words / nullif(w, 0), 0), 9) AS share, coalesce(phrase_words / nullif(w, 0), 0) > 0.3 AS low FROM e""",
    "txt27_quick_facts": f"WITH {_S} SELECT doc_id, pos, length(s) AS chars FROM s WHERE length(s) > 20 AND length(s) < 200 AND {_STAT} ORDER BY doc_id, pos LIMIT 25",
    "txt28_intents": seen(L.INTENTS, "intent"),
    "txt28_manifest_entities": seen(L.MANIFEST_ENTITIES, "entity_type"),
    "txt29_topics": f"WITH {_T}, e AS (SELECT doc_id, {_TOPICS} AS x FROM d), f AS (SELECT doc_id, list_filter(x, lambda w, i: list_position(x, w) = i) AS x FROM e) SELECT doc_id, len(x) AS topics, array_to_string(x[1:8], ' ') AS first_topics FROM f",
    "txt34_listicle": f"WITH {_LIST} SELECT doc_id, CASE WHEN m < 0.3 THEN NULL WHEN c = m THEN 'comparison' WHEN l = m THEN CASE WHEN top THEN 'topN' ELSE 'roundup' END ELSE 'faq' END AS format, m >= 0.5 AS suitable, floor(least(m, 1.0) * 100 + 0.5) / 100 AS confidence FROM g",
    "flt07_question_lines": f"""WITH {_T}, l AS (SELECT doc_id, {_TRIM.format("unnest(string_split(t, chr(10)))")} AS l FROM d) SELECT doc_id, count(*) FILTER (regexp_matches(l, '(?i)^(what|how|why|when|where|who|which|can|does|is|are|will|should)\\s+.+\\?')
        OR regexp_matches(l, '^\\*\\*Q:\\*\\*\\s*(.+)') OR regexp_matches(l, '^Q:\\s*(.+)') OR regexp_matches(l, '(?i)^Question:\\s*(.+)')) AS questions FROM l GROUP BY 1""",
    "ent03_sentence_context": f"WITH {_T}, e AS (SELECT doc_id, list_filter({_ROUGH}, lambda s: contains(lower(s), 'sitemap')) AS x FROM d) SELECT doc_id, len(x) AS n, length(x[1]) AS first_chars FROM e WHERE len(x) > 0",
    "ent04_name": f"WITH {_T} SELECT doc_id, coalesce(nullif(regexp_extract(t, '(?m)^#\\s+(.+)$', 1), ''), nullif(regexp_extract(t, '(?i)<h1[^>]*>([^<]+)</h1>', 1), '')) AS name FROM d",
}
QUERIES = {f.__name__: f for f in (
    txt01_tables, txt02_bullet_lists, txt03_statistics, txt04_header_levels, txt05_header_hierarchy, txt06_density_score, txt07_justification, txt08_density_advice, txt09_density,
    flt08_needs_improvement, agg12_mean_density, snk16_summary, txt11_commodity_phrases, txt14_fluff, txt15_elements, txt17_sentences, txt18_rough_sentences, flt06_sentence_tests,
    txt19_snippet_scores, win02_top_snippets, txt20_anchors, txt21_citation_parts, agg19_ranked_pages, txt22_words_paragraphs, win08_featured_paragraph, txt26_differentiation,
    txt27_quick_facts, txt28_intents, txt28_manifest_entities, txt29_topics, txt34_listicle, flt07_question_lines, ent03_sentence_context, ent04_name)}
