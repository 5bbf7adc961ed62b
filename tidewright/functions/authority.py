"""Authority of domains from their names, kinds of pages, keywords in context, weighted phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.functions.paths import js_round, let
from tidewright.functions.structure import occurrences_of, regex, word_count
from tidewright.lexicons import domains as D, pages as G, phrases as P


def _table(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def heuristic_authority(domain: Column, known: Sequence[tuple[str, int]] = ()) -> Column:
    """10 to 100. A known domain has its score; a subdomain of one the score less 5 (official names, at least 60), 20 (long or with digits, at least 40) or 10
    (at least 50); the first known domain counts. Others start from their ending and gain or lose by length, words, digits, hyphens and odd letters."""
    d = F.regexp_replace(F.lower(domain), r"^www\.", "")
    parts = F.split(d, r"\.")
    name, ending = F.element_at(parts, 1), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ".")
    endings = _table(D.ENDING_SCORES.items())
    score = F.coalesce(F.try_element_at(endings, ending), F.try_element_at(endings, F.element_at(parts, -1)), F.lit(D.ENDING_DEFAULT))
    n, letters, listed = F.length(name), name.rlike("^[a-z]+$"), name.isin(D.DICTIONARY_WORDS)
    vowels = F.length(F.regexp_replace(name, "[^aeiou]", ""))
    digits, hyphens = F.length(F.regexp_replace(name, "[^0-9]", "")), F.length(F.regexp_replace(name, "[^-]", ""))
    on = lambda cond, x: F.when(cond, x).otherwise(0)
    score = score + F.when(n <= 3, 20).when(n <= 5, 15).when(n <= 7, 10).when(n <= 10, 5).otherwise(0)
    score = score + F.when(letters & listed, 15).when(letters & n.between(4, 10), 8).otherwise(0)
    score = score + on(name.rlike("^[a-z]{3,6}$"), 5)
    score = score + on(name.rlike("^[a-z]{6,12}$") & ~listed & (vowels >= 2) & (n - vowels >= 3) & (vowels / n > 0.25), 5)
    score = score + on((ending == "com") & (n <= 6) & letters, 10)
    score = score - F.when(digits == 0, 0).when(name.rlike(r"[0-9]{4}$") & (n > 6), 5).when(digits > 2, 25).otherwise(15)
    score = score - F.when(hyphens == 0, 0).when((hyphens == 1) & (n <= 15), 5).when(hyphens > 2, 25).otherwise(10)
    score = score - F.when(n > 25, 20).when(n > 20, 15).when(n > 15, 8).otherwise(0)
    score = score - on(name.rlike(D.SUSPICIOUS_START), 12) - on(name.rlike(D.SUSPICIOUS_END), 8)
    score = score - on(name.rlike("[bcdfghjklmnpqrstvwxyz]{5,}"), 15) - on(name.rlike("[aeiou]{4,}"), 10) - on(name.rlike(r"(.)\1{2,}"), 10)
    out = F.greatest(F.lit(10), F.least(F.lit(100), score))
    for k, s in reversed(known):
        sub = F.substring(d, F.lit(1), F.length(d) - len(k) - 1)
        under = F.when(sub.isin(D.OFFICIAL_SUBDOMAINS), max(s - 5, 60)).when((F.length(sub) > 15) | sub.rlike("[0-9]"), max(s - 20, 40)).otherwise(max(s - 10, 50))
        out = F.when(d.endswith("." + k), under).otherwise(out)
    exact = F.try_element_at(_table(known), d) if known else F.lit(None)
    return F.coalesce(exact, out)


def domain_scores(names: DataFrame, column: str, told: DataFrame, least_sure: bool = True) -> DataFrame:
    """domain (lower case, without www), score, source, confidence: what a service told of a domain (told: domain, score), else by its name; where the name is
    not to be judged (least_sure off), 30 with little confidence. Each domain once."""
    d = names.select(F.regexp_replace(F.lower(column), r"^www\.", "").alias("domain")).where("domain is not null").distinct()
    known = told.select("domain", F.col("score").cast("int").alias("_told"))
    guess = heuristic_authority(F.col("domain")).cast("int") if least_sure else F.lit(30)
    out = d.join(known, "domain", "left")
    return out.select("domain", F.coalesce("_told", guess).alias("score"), F.when(F.col("_told").isNull(), "heuristic").otherwise("api").alias("source"),
                      F.when(F.col("_told").isNotNull(), 0.9).otherwise(0.5 if least_sure else 0.1).alias("confidence"))


def page_kinds(text: Column) -> dict[str, Column]:
    """How many patterns of each kind of page a text has."""
    out = {}
    for kind, patterns in G.PAGE_PATTERNS.items():
        hits = [F.when(text.rlike(("(?i)" if "i" in f else "") + regex(p, "m" in f)), 1).otherwise(0) for p, f in patterns]
        out[kind] = sum(hits[1:], hits[0])
    return out


def _before(text: Column, keyword: str, chars: int) -> Column:
    """The characters before each occurrence of a keyword, in lower case."""
    pieces = F.split(F.lower(text), regex_quote(keyword))
    back = chars // len(keyword) + 1  # so many earlier pieces can reach into the window
    first = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(first, lambda _, i: F.right(F.array_join(F.slice(pieces, F.greatest(i + 1 - back, F.lit(1)), F.least(i + 1, F.lit(back + 1))), keyword), F.lit(chars)))


def regex_quote(s: str) -> str:
    import re

    return re.escape(s)


def is_negated(text: Column, keyword: str) -> Column:
    """Whether a negation stands in the 50 characters before an occurrence of the keyword."""
    return F.exists(_before(text, keyword, 50), lambda s: s.rlike("|".join(regex(p) for p in G.NEGATIONS)))


def is_compared(text: Column, keyword: str) -> Column:
    """Whether a comparison stands in the 30 characters before an occurrence of the keyword."""
    return F.exists(_before(text, keyword, 30), lambda s: s.rlike("|".join(regex(p) for p in G.COMPARISONS)))


def phrase_list(custom: Sequence[tuple[str, float, str]] = (), industries: Sequence[str] = (), without: Sequence[str] = (), categories: Sequence[str] | None = None,
                without_categories: Sequence[str] = (), least: float = 0.0) -> list[tuple[str, float, str]]:
    """(phrase, weight, category): the stock phrases, those of industries and custom ones, less those that are named, of other categories or of less weight.
    Of equal phrases the last counts."""
    named = {p.lower() for p in without}
    every = [*P.WEIGHTED_PHRASES, *(x for i in industries for x in P.INDUSTRY_PHRASES[i]), *custom]
    kept = {p.lower(): (p.lower(), w, c) for p, w, c in every if p.lower() not in named and w >= least and (categories is None or c in categories) and c not in without_categories}
    return list(kept.values())


def weighted_phrases(text: Column, phrases: Sequence[tuple[str, float, str]], categories: Sequence[str] | None = None, least: float = 0.0) -> Column:
    """array<struct<impact, phrase, weight, n>> of the phrases (phrase, weight, category) that occur, by falling impact."""
    chosen = [(p, w) for p, w, c in phrases if w >= least and (categories is None or c in categories)]

    def found(low: Column) -> Column:
        counts = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("weight"), occurrences_of(low, p).alias("n")) for p, w in chosen])
        some = F.filter(counts, lambda s: s["n"] > 0)
        return F.array_sort(F.transform(some, lambda s: F.struct((-s["weight"] * s["n"]).alias("impact"), s["phrase"].alias("phrase"), s["weight"].alias("weight"), s["n"].alias("n"))))

    return let(F.lower(text), found)


def weighted_fluff(found: Column, text: Column) -> Column:
    """60 % the share of words in phrases, 40 % their mean weight; at most 100; 0 without phrases."""
    total = word_count(text)
    covered = F.aggregate(found, F.lit(0), lambda a, s: a + s["n"] * F.size(F.split(s["phrase"], " ")))
    weight = F.aggregate(found, F.lit(0.0), lambda a, s: a + s["n"] * s["weight"])
    share = F.coalesce(F.try_divide(100.0 * covered, total), F.lit(0.0))
    mean = F.coalesce(F.try_divide(100.0 * weight, F.size(found)), F.lit(0.0))
    return F.when((F.size(found) == 0) | (total == 0), 0).otherwise(F.least(F.lit(100), js_round(F.round(share * 0.6 + mean * 0.4, 9))))
