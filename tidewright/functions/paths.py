"""Paths, URLs and the similarity of short strings, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from tidewright.lexicons.words import EXCLUDED_PATHS, SYNONYMS, SYNONYM_WEIGHT


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once. An expression that a lambda refers to is otherwise computed anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def js_round(c: Column, digits: int = 0) -> Column:
    """Rounds halves up, towards positive infinity."""
    return F.floor(c + 0.5) if not digits else F.floor(c * 10**digits + 0.5) / 10**digits


def words(c: Column, pattern: str = r"\s+") -> Column:
    return F.filter(F.split(c, pattern), lambda x: x != "")


def decoded(path: Column) -> Column:
    """Percent-decoded; as it was where that fails. A plus sign stays."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def tokenize_path(path: Column) -> Column:
    """Lower-case words between slashes, hyphens and underscores; [] for null and blank paths."""
    parts = F.split(F.regexp_replace(decoded(path), "^/+|/+$", ""), r"[/\-_]+")
    tokens = F.filter(F.transform(parts, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.coalesce(tokens, F.array().cast("array<string>"))


def semantic_tokens(path: Column) -> Column:
    return F.array_sort(F.array_distinct(tokenize_path(path)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token lists as sets: 1 if both are empty, 0 if one is."""
    both = (F.size(a) == 0) & (F.size(b) == 0)
    union = F.size(F.array_union(a, b))
    return F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union), F.lit(0.0)))


def synonym_group(token: Column) -> Column:
    """The number of the first synonym group with the token, or null."""
    seen: dict[str, int] = {}
    for i, group in enumerate(SYNONYMS):
        for w in group:
            seen.setdefault(w, i)
    table = F.create_map(*[F.lit(x) for kv in seen.items() for x in kv])
    return F.try_element_at(table, token)


def token_weight(a: Column, b: Column, edits: int = 2) -> Column:
    """1 for equal tokens, 0.8 for synonyms and for those within the edit distance, else 0."""
    close = (F.abs(F.length(a) - F.length(b)) <= edits) & (F.levenshtein(a, b, edits) >= 0)
    same = F.coalesce(synonym_group(a) == synonym_group(b), F.lit(False))
    return F.when(a == b, 1.0).when(same | close, SYNONYM_WEIGHT).otherwise(0.0)


def token_similarity(a: Column, b: Column, edits: int = 2) -> Column:
    """Mean of the best weights of either list's tokens in the other, averaged over both directions; repeated tokens count."""

    def one_way(x: Column, y: Column) -> Column:
        best = F.transform(x, lambda s: F.array_max(F.transform(y, lambda t: token_weight(s, t, edits))))
        return F.aggregate(best, F.lit(0.0), lambda acc, w: acc + w) / F.size(x)

    def both_ways(x: Column, y: Column) -> Column:
        empty_x, empty_y = F.size(x) == 0, F.size(y) == 0
        return F.when(empty_x & empty_y, 1.0).when(empty_x | empty_y, 0.0).otherwise((one_way(x, y) + one_way(y, x)) / 2)

    return let(a, lambda x: let(b, lambda y: both_ways(x, y)))


def soundex(c: Column) -> Column:
    """Letter and three digits; vowels, H, W and Y are passed over without separating equal codes. '' without letters."""
    letters = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    coded = F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUHWY", "11112222222233455600000000")
    plain = F.regexp_replace(F.regexp_replace(coded, "0", ""), r"(\d)\1+", "$1")
    own = F.translate(F.substring(letters, 1, 1), "BFPVCGJKQSXZDTLMNRAEIOUHWY", "11112222222233455600000000")
    rest = F.when((own != "0") & (F.substring(plain, 1, 1) == own), F.substring(plain, 2, 99)).otherwise(plain)
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), rest), 4, "0"))


def ngrams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams in lower case; a shorter string is one gram, an empty one none."""

    def of(low: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))

    return let(F.lower(c), of)


def ngram_similarity(a: Column, b: Column, n: int = 2) -> Column:
    """Dice coefficient of the n-gram sets."""
    def dice(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), (F.size(x) + F.size(y)).cast("double")), F.lit(0.0))

    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(let(ngrams(a, n), lambda x: let(ngrams(b, n), lambda y: dice(x, y))))


def _sum_of(k: str, m: str):
    return lambda acc, s: acc + s[k] * s[m]


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of word counts, without punctuation and case."""
    def measure(counts: Column) -> Column:
        dot, p2, q2 = (F.aggregate(counts, F.lit(0.0), _sum_of(k, m)) for k, m in (("p", "q"), ("p", "p"), ("q", "q")))
        return F.coalesce(F.try_divide(dot, F.sqrt(p2) * F.sqrt(q2)), F.lit(0.0))

    def counted(x: Column, y: Column) -> Column:
        return F.transform(F.array_union(x, y), lambda w: F.struct(F.size(F.filter(x, lambda t: t == w)).alias("p"), F.size(F.filter(y, lambda t: t == w)).alias("q")))

    x, y = (words(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " ")) for c in (a, b))
    return F.when(a == b, 1.0).otherwise(let(x, lambda u: let(y, lambda v: let(counted(u, v), measure))))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, f in zip(b, free) if not f]
    m, moved = len(left), sum(x != y for x, y in zip(left, right)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: Column, b: Column, p: float = 0.1) -> Column:
    """Jaro-Winkler similarity: a prefix of up to four equal characters always counts; p is held within [0, 0.25]."""
    p = min(max(p, 0.0), 0.25)

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y):
            if s is None or t is None:
                out.append(None)
                continue
            j, same = _jaro(s, t), 0
            for c, d in zip(s[:4], t[:4]):
                if c != d:
                    break
                same += 1
            out.append(j + same * p * (1 - j))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(each, "double")(a, b)


def without_words(c: Column, listed: list[str]) -> Column:
    """The string without the listed words, in single spaces; with an empty list it stays as it is."""
    if not listed:
        return c
    low = F.array(*[F.lit(w.lower()) for w in listed])
    return F.array_join(F.filter(words(c), lambda w: ~F.array_contains(low, F.lower(w))), " ")


def url_path(url: Column) -> Column:
    """The path of an address; '/' where it has none; a bare path gets its leading slash."""
    absolute = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(absolute, F.when(path == "", "/").otherwise(path)).otherwise(F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url)))


def url_domain(url: Column) -> Column:
    """Host in lower case without www. and port."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*://)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def excluded(path: Column) -> Column:
    out = F.lit(False)
    for p in EXCLUDED_PATHS:
        out = out | path.startswith(p)
    return out


def topic_hash(text: Column) -> Column:
    """h * 31 + c over the characters in 32 bits with sign, in base 16; a negative one with its sign."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    value = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))
    signed = F.when(value >= 2147483648, value - 4294967296).otherwise(value)
    return F.concat(F.when(signed < 0, "-").otherwise(""), F.lower(F.hex(F.abs(signed))))


def content_hash(text: Column) -> Column:
    """A 32-bit hash over the first 1,000 characters and the length, as eight hex digits, and the length."""
    codes = F.transform(F.filter(F.split(F.substring(text, 1, 1000), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    value = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: F.pmod(h * 33 + c, F.lit(4294967296)))
    value = F.pmod(value * 33 + F.length(text), F.lit(4294967296))
    return F.concat(F.lpad(F.lower(F.hex(value)), 8, "0"), F.lit("_"), F.length(text).cast("string"))
