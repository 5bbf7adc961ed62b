"""Path functions, sentiment and authority on golden rows and random strings."""

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidewright.functions import paths as P
from tidewright.operators import citations as C

COMMON = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_soundex(spark):
    for word, code in (("Robert", "R163"), ("Rupert", "R163"), ("Tymczak", "T520"), ("Honeyman", "H500"), ("123", ""), ("a", "A000")):
        assert one(spark, x=P.soundex(F.lit(word))).x == code


def test_tokens(spark):
    assert one(spark, x=P.tokenize_path(F.lit("/Shop/red-shoes_42//a%20b/"))).x == ["shop", "red", "shoes", "42", "a b"]
    assert one(spark, x=P.tokenize_path(F.lit("/a%ZZ-b"))).x == ["a%zz", "b"]
    assert one(spark, x=P.tokenize_path(F.lit(None).cast("string"))).x == []


@COMMON
@given(st.lists(st.tuples(st.text("abcde/-_", max_size=12), st.text("abcde/-_", max_size=12)), min_size=1, max_size=20))
def test_similarity_is_symmetric(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    ta, tb = P.tokenize_path(a), P.tokenize_path(b)
    rows = df.select(P.token_similarity(ta, tb).alias("x"), P.token_similarity(tb, ta).alias("y"), P.ngram_similarity(a, b).alias("g"), P.ngram_similarity(b, a).alias("h"),
                     P.jaro_winkler(a, b).alias("j"), P.jaro_winkler(b, a).alias("k"), P.token_similarity(ta, ta).alias("i")).collect()
    for r in rows:
        assert abs(r.x - r.y) < 1e-9 and abs(r.g - r.h) < 1e-9
        assert 0 <= r.x <= 1 and 0 <= r.g <= 1 and 0 <= r.j <= 1 + 1e-9 and r.i == 1


def test_jaro_winkler(spark):
    r = one(spark, a=P.jaro_winkler(F.lit("MARTHA"), F.lit("MARHTA")), b=P.jaro_winkler(F.lit(""), F.lit("")), c=P.jaro_winkler(F.lit("abcd"), F.lit("axyz")))
    assert abs(r.a - 0.961111) < 1e-5 and r.b == 1 and abs(r.c - 0.55) < 1e-9


def test_sentiment(spark):
    cases = {
        "A great and reliable tool, I love it": "positive", "This is not great and I would avoid it": "negative", "A plain text": "neutral",
        "terrible, slow and broken": "negative", "I don't recommend this; not reliable": "negative", "": "neutral",
    }
    for text, want in cases.items():
        assert one(spark, x=C.sentiment(F.lit(text))).x == want, text
    assert one(spark, x=C.sentiment(F.lit(None).cast("string"))).x is None


def test_empty_inputs(spark):
    rows = spark.createDataFrame([], "sentiment string, is_earned_media boolean, domain_authority int")
    assert C.store_stats(rows).first().total == 0 and C.citation_authority(rows).first().authority == 0
