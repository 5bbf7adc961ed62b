"""Structure and wording of texts, as Column expressions. Patterns are ASCII-minded: a word boundary lies between ASCII word characters and others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tidewright.functions.paths import js_round, let, words
from tidewright.lexicons import words as L

TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_SEPARATOR = r"^\s*\|[\s:-]+(?:\|[\s:-]+)+\|\s*$"
BULLET = r"^[\s]*[-*+]\s+.+$"
NUMBERED = r"^[\s]*\d+\.\s+.+$"
STATISTICS = [r"\d+(?:\.\d+)?%", r"\$[\d,]+(?:\.\d{2})?", r"\b\d{1,3}(?:,\d{3})+\b", r"(?i)\d+(?:\.\d+)?\s*(?:kg|lb|oz|g|ml|L|m|cm|mm|ft|in|mph|km/h)"]
MARKDOWN_HEADER = r"^#{1,6}\s+.+$"
HTML_HEADER = r"(?i)<h([1-6])[^>]*>"
JSON_LD = r"(?i)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>"
PROS_CONS = r"(?i)(?:pros|cons|advantages|disadvantages|benefits|drawbacks)[\s:]"
BOLD = r"\*\*[^*]+\*\*"


def regex(p: str, multiline: bool = False) -> str:
    """The pattern for this engine: lines end at \\n only, boundaries are ASCII."""
    p = p.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
    return ("(?md)" if multiline else "") + p


def plain_lines(text: Column) -> Column:
    """With \\n as the only line end; '' for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def count(text: Column, p: str, multiline: bool = False) -> Column:
    return F.regexp_count(text, F.lit(regex(p, multiline)))


def find_all(text: Column, p: str, group: int = 0, multiline: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(regex(p, multiline)), F.lit(group))


def any_of(text: Column, patterns: Sequence[tuple[str, bool]]) -> Column:
    """Whether one of (pattern, ignore case) is found."""
    out = F.lit(False)
    for p, ignore in patterns:
        out = out | text.rlike(("(?i)" if ignore else "") + regex(p))
    return out


def tables(text: Column) -> Column:
    n = count(text, TABLE_SEPARATOR, True)
    return F.when((count(text, TABLE_ROW, True) >= 3) & (n >= 1), n).otherwise(0)


def bullet_lists(text: Column) -> Column:
    """Runs of bullet or numbered lines; blank lines do not end a run."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"\S"))
    marks = F.transform(lines, lambda s: s.rlike(f"(?:{BULLET})|(?:{NUMBERED})"))
    return let(marks, lambda m: F.size(F.filter(F.transform(m, lambda x, i: x & ((i == 0) | ~F.element_at(m, F.greatest(i, F.lit(1))))), lambda x: x)))


def statistics(text: Column) -> Column:
    """Distinct percentages, amounts, grouped numbers and measurements."""
    return F.size(F.array_distinct(F.concat(*[find_all(text, p) for p in STATISTICS])))


def header_levels(text: Column) -> Column:
    """Levels of markdown headers in order, then those of HTML headers."""
    md = F.transform(find_all(text, MARKDOWN_HEADER, 0, True), lambda h: F.length(F.regexp_extract(h, "^(#+)", 1)))
    return F.concat(md, F.transform(find_all(text, HTML_HEADER, 1), lambda h: h.cast("int")))


def valid_hierarchy(levels: Column) -> Column:
    """No header goes more than one level deeper than the one before."""

    def steady(v: Column) -> Column:
        less = F.greatest(F.size(v) - 1, F.lit(0))
        return (F.size(v) < 2) | F.forall(F.zip_with(F.slice(v, F.lit(1), less), F.slice(v, F.lit(2), less), lambda a, b: b <= a + 1), lambda x: x)

    return let(levels, steady)


def density_score(t: Column, b: Column, s: Column, h: Column, valid: Column) -> Column:
    raw = (0.25 * F.least(t / 2, F.lit(1.0)) + 0.20 * F.least(b / 3, F.lit(1.0)) + 0.25 * F.least(s / 5, F.lit(1.0)) + 0.15 * F.least(h / 4, F.lit(1.0)) + F.when(valid, 0.15).otherwise(0.0))
    return js_round(raw, 2)


def breakdown(text: Column) -> dict[str, Column]:
    levels = header_levels(text)
    return {"tables": tables(text), "bullet_lists": bullet_lists(text), "statistics": statistics(text), "headers": F.size(levels), "valid_hierarchy": valid_hierarchy(levels)}


def phrases_in(text: Column, listed: Sequence[str]) -> Column:
    """The listed phrases that the text contains anywhere, in list order."""
    every = F.array(*[F.lit(p) for p in listed])
    return let(F.lower(text), lambda low: F.filter(every, lambda p: F.contains(low, p)))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def phrase_words(found: Column) -> Column:
    return F.aggregate(F.transform(found, lambda p: F.size(F.split(p, r"\s+"))), F.lit(0), lambda a, n: a + n)


def fluff_score(text: Column) -> Column:
    """0 to 100 by the share of words in fluffy and commodity phrases, each counted once; 30 % make 70."""
    share = F.coalesce(F.try_divide(100.0 * phrase_words(phrases_in(text, list(dict.fromkeys(L.FLUFFY_PHRASES + L.COMMODITY_PHRASES)))), word_count(text)), F.lit(0.0))
    return F.round(F.least(F.when(share >= 30, 70 + F.least(F.lit(30.0), share - 30)).otherwise(js_round(share / 30 * 70)), F.lit(100.0)), 6)


def occurrences_of(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences in a text in lower case."""
    low = text
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def sentences(text: Column) -> Column:
    """Cut after . ! ? before white space; trimmed, none empty."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def rough_sentences(text: Column) -> Column:
    """Cut at every run of . ! ?; trimmed, none empty."""
    parts = F.split(text, r"[.!?]+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    parts = F.split(text, r"\n\n+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def has_statistic(s: Column) -> Column:
    return any_of(s, L.STATISTIC_PATTERNS)


def has_attribution(s: Column) -> Column:
    return any_of(s, L.ATTRIBUTION_PATTERNS)


def is_specific(s: Column) -> Column:
    return any_of(s, L.SPECIFICITY_PATTERNS)


def is_unique(s: Column) -> Column:
    return F.size(phrases_in(s, L.DIFFERENTIATION_PHRASES)) == 0


def snippet_score(s: Column) -> Column:
    """30 for a statistic, 25 without a stock phrase, 20 if specific, 15 within 280 characters, 10 with a source."""
    p = lambda c, n: F.when(c, n).otherwise(0)
    return p(has_statistic(s), 30) + p(is_unique(s), 25) + p(is_specific(s), 20) + p(F.length(s) <= 280, 15) + p(has_attribution(s), 10)


def topics(text: Column) -> Column:
    """Distinct words of more than three letters without stop words, in order."""
    low = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")
    long = F.filter(words(low), lambda w: F.length(w) > 3)
    return F.array_except(F.array_distinct(long), F.array(*[F.lit(w) for w in L.TOPIC_STOP_WORDS]))


def listicle(text: Column) -> dict[str, Column]:
    """Scores for a comparison, a list and questions; the best decides the format, comparison before list before questions."""
    vs = count(text, r"(?i)\bvs\.?\b|\bversus\b")
    comparison = F.when(vs > 0, 0.3 * F.least(vs, F.lit(3))).otherwise(0.0)
    top = text.rlike(regex(r"(?i)\btop\s+\d+\b|\bbest\s+\d+\b"))
    listing = (F.when(count(text, r"^\s*[-*•]\s+.+$", True) >= 3, 0.4).otherwise(0.0) + F.when(count(text, r"^\s*\d+\.\s+.+$", True) >= 3, 0.4).otherwise(0.0) + F.when(top, 0.2).otherwise(0.0))
    marks = count(text, r"\?")
    faq = F.when(marks >= 3, 0.3 + F.least(marks / 20, F.lit(0.3))).otherwise(0.0) + F.when(text.rlike("(?i)(?:Q:|Question:|FAQ)"), 0.3).otherwise(0.0)
    most = F.round(F.greatest(comparison, listing, faq), 9)
    kind = F.when(most < 0.3, None).when(F.round(comparison, 9) == most, "comparison").when(F.round(listing, 9) == most, F.when(top, "topN").otherwise("roundup")).otherwise("faq")
    return {"format": kind, "suitable": most >= 0.5, "confidence": js_round(F.least(most, F.lit(1.0)), 2)}
