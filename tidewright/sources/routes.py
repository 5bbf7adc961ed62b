"""Routes from sitemaps, file trees and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.functions.paths import url_path
from tidewright.operators.citations import keep_first


def entry_route(loc: Column, base: str = "") -> Column:
    """The path of a sitemap address: behind the base, or its path; with a leading and without a trailing slash."""
    p = F.when(loc.startswith(base), F.substring(loc, len(base) + 1, 1_000_000)).otherwise(url_path(loc)) if base else F.when(loc.startswith("http"), url_path(loc)).otherwise(loc)
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.regexp_replace(p, r"(.)/$", "$1")


def file_route(file: Column) -> Column:
    """The route of a page file below an app folder, or null for other files and skipped folders.

    Folders that begin with _ . or @, api and node_modules are skipped with all below; (groups) add no segment.
    """
    inside = F.regexp_extract(file, r"(?:^|/)app/(?:(.*)/)?page\.(?:tsx|ts|jsx|js)$", 1)
    is_page = file.rlike(r"(?:^|/)app/(?:.*/)?page\.(?:tsx|ts|jsx|js)$")
    parts = F.filter(F.split(inside, "/"), lambda s: s != "")
    skipped = F.exists(parts, lambda s: s.rlike(r"^[_.@]") | s.isin("api", "node_modules"))
    kept = F.filter(parts, lambda s: ~s.rlike(r"^\(.*\)$"))
    return F.when(is_page & ~skipped, F.concat(F.lit("/"), F.array_join(kept, "/")))


def filesystem_routes(spark, folder: str) -> DataFrame:
    """path, last_modified of the page files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    return files.select(file_route(F.col("path")).alias("path"), F.col("modificationTime").alias("last_modified")).where("path is not null")


def first_of_sources(sources: list[DataFrame], most: int | None = None) -> DataFrame:
    """path, source, ord: the union of the sources in order, of equal paths the first. sources: path, source, ord (within the source)."""
    numbered = [s.select("path", "source", F.struct(F.lit(k).alias("k"), F.col("ord").alias("o")).alias("_at")) for k, s in enumerate(sources)]
    rows = keep_first(reduce(DataFrame.unionByName, numbered), ["path"], "_at")
    rows = rows.select("path", "source", F.col("_at.k").alias("source_no"), F.col("_at.o").alias("ord"))
    return rows.orderBy("source_no", "ord").limit(most) if most else rows


def dynamic_pattern(route: Column) -> Column:
    """[x] as one segment; [...x] and [[...x]] as well, as only paths of as many segments are compared."""
    escaped = F.regexp_replace(route, r"([.+*?^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\[\[?[^\[\]/]+\]?\]", "[^/]+"), F.lit("$"))
