"""Queries of the problems 1, 3, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewright.llm import mentions, mixing, packing, pii, splitting


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return mentions.repeated_mentions(read(spark, sf, "discovered_citations"))


#: Of the test queries only: in production the key comes from the caller's secret store.
TEST_KEY = b"test key of the redaction queries"


def _p3_texts(spark: SparkSession, sf: str):
    names = pii.given_name_set(read(spark, sf, "given_names"))
    return pii.texts_with_pii(read(spark, sf, "reddit_posts"), read(spark, sf, "discovered_citations")), names


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _p3_texts(spark, sf)
    return pii.occurrences(rows, ["record_table", "record_key"], "text", names).select("record_table", "record_key", "pii_type", "start_pos")


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _p3_texts(spark, sf)
    return pii.redacted(rows, ["record_table", "record_key"], "text", names, TEST_KEY)


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    sizes = packing.document_sizes(read(spark, sf, "documents"))
    return packing.pack(packing.items_of(sizes, packing.pack_settings(read(spark, sf, "size_settings"))))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers(_packed(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_report(packing.materialize(_packed(spark, sf), "packed"))


def p6_certificates(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_certificates(packing.materialize(_packed(spark, sf), "packed"))


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    sized = docs.select("doc_id", "source", packing.token_count(F.col("text")).alias("tokens"))
    return mixing.mix(packing.materialize(sized, "sizes"), read(spark, sf, "mix_targets"))


def p7_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(_mixed(spark, sf), read(spark, sf, "mix_targets"))


def p7_deviations(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.deviations(packing.materialize(_mixed(spark, sf), "mixed"), read(spark, sf, "mix_targets"))


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_documents(read(spark, sf, "documents"), splitting.split_settings(read(spark, sf, "size_settings")))


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per setting: the documents in containers, tokens that are missing or doubled, and containers above their capacity."""
    sizes = packing.document_sizes(read(spark, sf, "documents"))
    packed = packing.materialize(packing.pack(packing.items_of(sizes, packing.pack_settings(read(spark, sf, "size_settings")))), "packed")
    whole = packed.groupBy("setting_name", "doc_id").agg(F.sum("tokens").alias("packed")).join(sizes, "doc_id")
    a = whole.groupBy("setting_name").agg(F.count("*").alias("documents"), F.sum(F.abs(F.col("packed") - F.col("tokens"))).alias("tokens_off"))
    b = packed.groupBy("setting_name", "bin", "capacity").agg(F.sum("tokens").alias("used")).groupBy("setting_name").agg(F.sum((F.col("used") > F.col("capacity")).cast("long")).alias("overfull"))
    return a.join(b, "setting_name")


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per mix and source that has documents: whether no document is used too often and the share is within one in a hundred of the target's."""
    s = p7_shares(spark, sf).where("documents > 0")
    want = F.col("target_share") / F.sum("target_share").over(Window.partitionBy("mix_name"))  # a handful of rows per mix
    return s.select("mix_name", "doc_source", (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(F.col("actual_share") - want) < 0.01).alias("share_met"))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per setting: pieces above the limit, gaps between pieces, texts not begun or ended, pieces that are not the text at their place."""
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("whole"))
    limits = read(spark, sf, "size_settings").where("purpose = 'split'").select("setting_name", "max_tokens")
    p = p8_pieces(spark, sf).join(F.broadcast(limits), "setting_name").join(docs, "doc_id")
    one = p.withColumn("same", F.col("text") == F.substring("whole", F.col("start_pos").cast("int"), (F.col("end_pos") - F.col("start_pos") + 1).cast("int"))).withColumn("chars", F.length("whole")).drop("text", "whole")
    w = Window.partitionBy("setting_name", "doc_id").orderBy("piece_no")
    one = one.withColumn("gap", F.col("start_pos") > F.coalesce(F.lag("end_pos").over(w), F.lit(0)) + 1)
    n = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("long"))
    last = (F.col("piece_no") == F.col("pieces")) & (F.col("end_pos") != F.col("chars"))
    found = one.groupBy("setting_name").agg(n(F.col("tokens") > F.col("max_tokens")).alias("too_long"), n(F.col("gap")).alias("gaps"), n(last).alias("not_ended"), n(~F.col("same")).alias("altered"))
    return limits.select("setting_name").join(found, "setting_name", "left").fillna(0)


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_redacted, p6_containers, p6_report, p6_certificates, p7_selection, p7_shares, p7_deviations, p8_pieces, p6_checks, p7_checks, p8_checks)}
#: What must hold of packings, mixes and pieces, which SQL can say without the tokenizer.
_SOURCE = "lower(trim({0}))"
ORACLES: dict[str, str] = {
    "p6_checks": "SELECT setting_name, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, 0 AS tokens_off, 0 AS overfull FROM size_settings WHERE purpose = 'pack'",
    "p7_checks": f"""SELECT DISTINCT mix_name, {_SOURCE.format('doc_source')} AS doc_source, true AS repeats_kept, true AS share_met FROM mix_targets
        WHERE target_weight > 0 AND max_repeats > 0 AND {_SOURCE.format('doc_source')} IN (SELECT {_SOURCE.format('source')} FROM documents WHERE length(text) > 0)""",
    "p8_checks": "SELECT setting_name, 0 AS too_long, 0 AS gaps, 0 AS not_ended, 0 AS altered FROM size_settings WHERE purpose = 'split'",
}
