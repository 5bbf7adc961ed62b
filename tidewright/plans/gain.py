"""Queries on the facts in texts, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import gain as I
from tidewright.lexicons import gain as G, words as L
from tidewright.plans.content import _T, _WC, docs, lit


def txt10_unique_entities(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(I.unique_entities(F.col("t"))).alias("entity"))


def txt12_information_gain(spark, sf):
    d = docs(spark, sf).select("doc_id", I.unique_entities(F.col("t")).alias("e"), I.stock_share(F.col("t")).alias("stock_percent"))
    return d.select("doc_id", F.size("e").alias("entities"), "stock_percent", I.information_gain(F.col("e"), F.col("stock_percent")).alias("score"))


def _all(k):
    p, g = G.FACTS[k]
    found = f"regexp_extract_all(c, {lit(p)}, {g})"
    found = f"list_transform({found}, lambda s: trim(s))"
    if k == "term":
        return f"list_filter({found}, lambda s: length(s) >= 3 OR s IN ({', '.join(map(lit, G.SHORT_TERMS))}))"
    if k == "camel":
        return f"list_filter({found}, lambda s: s NOT IN ({', '.join(map(lit, G.CAMEL_EXCEPTIONS))}))"
    return found


_CLEAN = "t"
for _p, _to in G.MARKS:
    _CLEAN = f"regexp_replace({_CLEAN}, {lit(_p)}, {lit(_to.replace('$', chr(92)))}, 'g')"
_KEPT = f"""length(s) BETWEEN 2 AND 50 AND NOT regexp_matches(s, '^\\d+$') AND s NOT IN ({', '.join(map(lit, G.COMMON_WORDS))}) AND NOT (regexp_matches(s, '[:\\-]\\s+\\w') AND length(s) > 10)
    AND NOT (regexp_matches(s, '^[a-z]') AND len(regexp_split_to_array(s, '\\s+')) > 3)"""
_E = f"""{_T}, c AS (SELECT doc_id, t, regexp_replace({_CLEAN}, '^\\s+|\\s+$', '', 'g') AS c FROM d),
    e AS (SELECT doc_id, t, list_filter(list_distinct(list_concat({', '.join(_all(k) for k in G.FACTS)})), lambda s: {_KEPT}) AS l FROM c)"""
_WORTH = "CASE " + " ".join(f"WHEN regexp_matches(s, {lit(p)}) THEN {n}" for p, n in G.WORTH) + " ELSE 1 END"
_STOCK = f"list_sum(list_transform(list_filter([{', '.join(map(lit, L.COMMODITY_PHRASES))}], lambda p: contains(lower(t), p)), lambda p: len(regexp_split_to_array(p, '\\s+'))))"
ORACLES = {
    "txt10_unique_entities": f"WITH {_E} SELECT doc_id, unnest(l) AS entity FROM e",
    "txt12_information_gain": f"""WITH {_E}, s AS (SELECT doc_id, l, coalesce(floor(100.0::DOUBLE * coalesce({_STOCK}, 0) / nullif({_WC.format('t')}, 0) + 0.5), 0)::INT AS p, coalesce(list_sum(list_transform(l, lambda s: {_WORTH})), 0) AS w FROM e)
        SELECT doc_id, len(l)::INT AS entities, p AS stock_percent, floor(greatest(0, least(100, 50 + least(w, 60) - least(p * 1.5::DOUBLE, 50))) + 0.5)::INT AS score FROM s""",
}
QUERIES = {f.__name__: f for f in (txt10_unique_entities, txt12_information_gain)}
