"""How much a text says that others do not: the distinct facts in it, weighed, against its stock phrases."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewright.functions.paths import js_round, let
from tidewright.functions.structure import find_all, phrase_words, phrases_in, regex, word_count
from tidewright.lexicons import gain as G, words as L


def without_marks(text: Column) -> Column:
    """The text on one line, without markdown and HTML."""
    out = F.coalesce(text, F.lit(""))
    for p, to in G.MARKS:
        out = F.regexp_replace(out, p, to)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def unique_entities(text: Column) -> Column:
    """Distinct facts: terms in capitals, brands, products, compound names, numbers with a unit, prices, dates, versions, both sides of comparisons,
    rankings and addresses. People, places and organizations that only a language model finds are not among them.

    None is shorter than 2 or longer than 50 characters, a bare number, a common word, or longer text by its look. A null text has none.
    """

    def found(t: Column) -> Column:
        each = {k: F.transform(find_all(t, p, g), lambda s: F.trim(s)) for k, (p, g) in G.FACTS.items()}
        each["term"] = F.filter(each["term"], lambda s: (F.length(s) >= 3) | s.isin(G.SHORT_TERMS))
        each["camel"] = F.filter(each["camel"], lambda s: ~s.isin(G.CAMEL_EXCEPTIONS))
        return F.array_distinct(F.concat(*each.values()))

    def kept(s: Column) -> Column:
        n = F.length(s)
        return n.between(2, 50) & ~s.rlike(r"^\d+$") & ~s.isin(G.COMMON_WORDS) & ~(s.rlike(r"[:\-]\s+\w") & (n > 10)) & ~(s.rlike("^[a-z]") & (F.size(F.split(s, r"\s+")) > 3))

    return F.filter(let(without_marks(text), found), kept)


def stock_share(text: Column) -> Column:
    """Percent of the words that are in stock phrases, each phrase counted once."""
    return F.coalesce(js_round(F.try_divide(100.0 * phrase_words(phrases_in(text, L.COMMODITY_PHRASES)), word_count(text))), F.lit(0)).cast("int")


def information_gain(entities: Column, share: Column) -> Column:
    """0 to 100: 50, and up to 60 for the worth of the facts, less one and a half times the share of stock phrases, at most 50."""
    worth = lambda s: F.when(s.rlike(regex(G.WORTH[0][0])), G.WORTH[0][1]).when(s.rlike(G.WORTH[1][0]), G.WORTH[1][1]).when(s.rlike(G.WORTH[2][0]), G.WORTH[2][1]).otherwise(1)
    total = F.aggregate(F.transform(entities, worth), F.lit(0), lambda a, b: a + b)
    score = 50 + F.least(total, F.lit(60)) - F.least(share * 1.5, F.lit(50.0))
    return js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("int")
