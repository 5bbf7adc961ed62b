"""Sitemaps: parsing, cleaning and writing, as Column expressions and DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FREQUENCIES = ["always", "hourly", "daily", "weekly", "monthly", "yearly", "never"]
NAMED = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_xml(xml: Column) -> Column:
    """Without byte order mark, declaration, comments and blanks between tags; bare ampersands repaired."""
    c = F.regexp_replace(xml, "^﻿", "")
    c = F.regexp_replace(c, r"(?i)<\?xml[^?]*\?>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r">\s+<", "><")
    return F.regexp_replace(c, r"&(?!(amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", "&amp;")


def decode_entities(c: Column) -> Column:
    """The five named entities, then decimal and hexadecimal references of basic characters."""
    for name, ch in NAMED:
        c = F.replace(c, F.lit(name), F.lit(ch))
    # Split at references: every second part of the split is text, the captured numbers lie between.
    for pattern, base in ((r"&#(\d+);", 10), (r"&#x([0-9a-fA-F]+);", 16)):
        texts, numbers = F.split(c, pattern), F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        decoded = F.zip_with(texts, numbers, _joined(base))
        c = F.when(F.size(numbers) > 0, F.array_join(decoded, "")).otherwise(c)
    return c


def _joined(base: int):
    def one(text: Column, number: Column) -> Column:
        code = F.conv(number, base, 10).cast("int")
        return F.concat(F.coalesce(text, F.lit("")), F.when(number.isNull(), "").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.pmod(code, F.lit(65536))), 4, "0")), "UTF-16BE")))

    return one


def escape_xml(c: Column) -> Column:
    for name, ch in NAMED:
        c = F.replace(c, F.lit(ch), F.lit(name))
    return c


def parse_sitemap(documents: DataFrame, xml: str, lenient: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per <url> with a usable address: loc, lastmod, changefreq, priority; unusable optional fields are null. keep: columns carried along."""
    text = clean_xml(F.col(xml)) if lenient else F.col(xml)
    rows = documents.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))).alias("u"))
    field = lambda name: F.regexp_extract("u", f"(?i)<{name}>([^<]*)</{name}>", 1)
    loc = decode_entities(trim(field("loc")))
    freq, last, prio = F.lower(trim(field("changefreq"))), trim(field("lastmod")), F.try_to_number(F.regexp_extract(trim(field("priority")), r"^[+-]?\d+(?:\.\d+)?", 0), F.lit("S9999.9999")).cast("double")
    out = rows.select(*keep, loc.alias("loc"), F.when(last.rlike(r"^\d{4}-\d{2}-\d{2}"), last).alias("lastmod"), F.when(freq.isin(FREQUENCIES), freq).alias("changefreq"),
                      F.when((prio >= 0) & (prio <= 1), prio).alias("priority"))
    return out.where(F.col("loc").startswith("http") | F.col("loc").startswith("/"))


def parse_index(xml: Column) -> Column:
    """Addresses of the child sitemaps; only absolute ones."""
    found = F.regexp_extract_all(clean_xml(xml), F.lit(r"(?is)<sitemap>.*?<loc>([^<]*)</loc>.*?</sitemap>"), F.lit(1))
    return F.filter(F.transform(found, lambda u: decode_entities(trim(u))), lambda u: u.startswith("http"))


def is_index(xml: Column) -> Column:
    return F.contains(xml, F.lit("<sitemapindex"))


def entries_of(routes: DataFrame, base: str, day: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """loc, lastmod, changefreq, priority of the paths, without those that match an excluded pattern. routes: path, route_ord."""
    rows = routes
    for p in exclude:
        rows = rows.where(~F.col("path").rlike(p))
    return rows.select("route_ord", F.concat(F.lit(base), F.col("path")).alias("loc"), F.lit(day).alias("lastmod"), F.lit("weekly").alias("changefreq"), F.lit(0.5).alias("priority"))


def url_element(loc: Column, lastmod: Column, changefreq: Column, priority: Column) -> Column:
    def part(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"    <{name}>"), value, F.lit(f"</{name}>\n")), F.lit(""))

    return F.concat(F.lit("  <url>\n"), part("loc", escape_xml(loc)), part("lastmod", lastmod), part("changefreq", changefreq), part("priority", F.format_string("%.1f", priority)), F.lit("  </url>\n"))


def sitemap_files(entries: DataFrame, size: int = 1000) -> DataFrame:
    """chunk, urls, xml: files of at most `size` entries in route order. A file holds at most `size` rows, so no group is unbounded."""
    from tidewright.operators.prefix import running_number

    rows = running_number(entries, "route_ord", "_n").withColumn("chunk", F.floor(F.col("_n") / size))
    item = F.struct("_n", url_element(F.col("loc"), F.col("lastmod"), F.col("changefreq"), F.col("priority")).alias("x"))
    g = rows.groupBy("chunk").agg(F.count("*").alias("urls"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]), "").alias("body"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return g.select("chunk", "urls", F.concat(F.lit(head), F.col("body"), F.lit("</urlset>\n")).alias("xml"))


def index_file(files: DataFrame, base: str, day: str) -> DataFrame:
    """The index of the files; one entry per file."""
    loc = F.concat(F.lit(base + "/sitemap-"), F.col("chunk").cast("string"), F.lit(".xml"))
    item = F.struct("chunk", F.concat(F.lit("  <sitemap>\n    <loc>"), escape_xml(loc), F.lit(f"</loc>\n    <lastmod>{day}</lastmod>\n  </sitemap>\n")).alias("x"))
    g = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]), "").alias("body"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return g.select(F.concat(F.lit(head), F.col("body"), F.lit("</sitemapindex>\n")).alias("xml"))


def read_sitemaps(spark, folder: str) -> DataFrame:
    """name, xml of the files in a folder; compressed ones are unpacked by the reader."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("xml"))


def plain_entries(xml: Column) -> Column:
    """array<struct<loc, lastmod, changefreq, priority>> of a sitemap read as it stands: nothing is decoded or checked; an index has none."""
    blocks = F.filter(F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)), lambda b: b.rlike("<loc>[^<]+</loc>"))
    part = lambda b, n: F.nullif(trim(F.regexp_extract(b, f"<{n}>([^<]+)</{n}>", 1)), F.lit(""))
    return F.when(is_index(xml), F.slice(F.transform(blocks, lambda b: F.struct(*[part(b, n).alias(n) for n in ("loc", "lastmod", "changefreq", "priority")])), 1, 0)).otherwise(
        F.transform(blocks, lambda b: F.struct(*[part(b, n).alias(n) for n in ("loc", "lastmod", "changefreq", "priority")])))
