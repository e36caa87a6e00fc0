"""Smaller page facts: file names, text share, image checks, server, inbound links, fix lists, clusters and pairs in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from .records import NEXT_GEN, extension


def safe_name(url: Column) -> Column:
    """A file name for a URL: stem, eight digits of the md5 of path and query, extension; img where there is no stem, .bin without an extension."""
    whole = F.concat(U.path(url), F.when(U.query(url) != "", F.concat(F.lit("?"), U.query(url))).otherwise(F.lit("")))
    tag = F.substring(F.md5(whole), 1, 8)
    base = F.substring(F.regexp_replace(F.element_at(F.split(U.path(url), "/"), -1), r"[^A-Za-z0-9._-]+", "_"), 1, 60)
    stem, ext = F.regexp_extract(base, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(base, r"^(.*)\.([^.]*)$", 2)
    some = lambda c: F.when(c == "", F.lit("img")).otherwise(c)
    return F.when(base.contains("."), F.concat(some(stem), F.lit("_"), tag, F.lit("."), ext)).otherwise(F.concat(some(base), F.lit("_"), tag, F.lit(".bin")))


def page_slug(url: Column) -> Column:
    """The path as one name; home for the root."""
    bare = F.regexp_replace(F.regexp_replace(U.path(url), "^/+|/+$", ""), r"[^A-Za-z0-9._-]+", "_")
    return F.when(bare == "", F.lit("home")).otherwise(F.substring(bare, 1, 80))


def text_html_ratio(text: Column, html: Column) -> Column:
    """Bytes of visible text as a percentage of the page's, one decimal."""
    return F.round(100.0 * F.octet_length(text) / F.nullif(F.octet_length(html), F.lit(0)), 1)


def title_equals_h1(title: Column, h1: Column) -> Column:
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return (plain(title) != "") & (plain(title) == plain(h1))


def server(headers: Column) -> list[Column]:
    """server, powered_by, cdn from lower-cased response headers."""
    get = lambda k: F.try_element_at(headers, F.lit(k))
    cdn = (
        F.when(get("cf-ray").isNotNull(), "cloudflare").when(get("x-vercel-id").isNotNull(), "vercel").when(get("x-amz-cf-id").isNotNull(), "cloudfront")
        .when(F.contains(get("x-served-by"), F.lit("cache")), "fastly").when(F.contains(F.lower(get("server")), F.lit("akamai")), "akamai")
    )
    return [get("server").alias("server"), get("x-powered-by").alias("powered_by"), cdn.alias("cdn")]


def image_checks(images: DataFrame, url_checks: DataFrame, heavy_kb: int = 100) -> DataFrame:
    """images (url, src) with their probe: format by extension or else content type, size, whether too large or broken. Inline data isn't probed."""
    probes = url_checks.select(F.col("url").alias("_u"), "status", "content_type", "content_length")
    own = images.join(probes, (F.col("src") == F.col("_u")) & ~F.col("src").startswith("data:"), "left").drop("_u")
    kind = F.lower(F.trim(F.regexp_extract("content_type", r"^[^/;]*/?([^/;]*)", 1)))
    own = own.withColumn("format", F.coalesce(F.nullif(extension(F.col("src")), F.lit("")), F.nullif(kind, F.lit(""))))
    size = F.round(F.nullif("content_length", F.lit(0)) / 1024, 1)
    return own.select(
        *images.columns,
        "status",
        "format",
        F.col("format").isin(*NEXT_GEN).alias("next_gen"),
        size.alias("filesize_kb"),
        F.coalesce(size > heavy_kb, F.lit(False)).alias("oversized"),
        F.coalesce(F.col("status") >= 400, F.lit(False)).alias("broken"),
    )


def image_summary(checked: DataFrame) -> DataFrame:
    count = lambda c: F.sum(F.col(c).cast("int")).alias(f"{c}_count")
    return checked.groupBy("url").agg(F.count("*").alias("total"), count("oversized"), count("broken"), F.sum((~F.coalesce("next_gen", F.lit(False))).cast("int")).alias("non_next_gen_count"))


def local_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """images (src) with the stored file (name) they were saved as: the safe name, else the plain base name, else the stem with any extension."""
    base = F.element_at(F.split(U.path(F.col("src")), "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    names = F.array(safe_name(F.col("src")), base, stem)
    own = images.select("src").distinct().select("src", F.posexplode(names).alias("rank", "candidate")).where("candidate <> ''")
    known = files.select("name", F.explode(F.array_distinct(F.array(F.col("name"), F.regexp_replace("name", r"\.[^.]*$", "")))).alias("candidate"))
    best = own.join(known, "candidate").groupBy("src").agg(F.min_by("name", F.struct("rank", "name")).alias("file"))
    return images.join(best, "src", "left")


def with_text(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """pages (url, title, h1..h3) with the stored text of their url (url, text), else their title and headings."""
    heads = [F.col(c) for c in ("title", "h1", "h2", "h3") if c in pages.columns]
    joined = pages.join(texts.select("url", F.col("text").alias("_text")), "url", "left")
    return joined.withColumn("text", F.coalesce(F.nullif("_text", F.lit("")), F.concat_ws(" ", *heads))).drop("_text")


def ordered_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters by size, then similarity, with their place."""
    return clusters.orderBy(F.desc("size"), F.desc("max_similarity"), "cluster")


def top_pairs(pairs: DataFrame, most: int = 25) -> DataFrame:
    """The most similar pairs (a, b, shared, together)."""
    return pairs.select("a", "b", F.expr(T.rounded("(shared / together)", 3)).alias("similarity")).orderBy(F.desc("similarity"), "a", "b").limit(most)


def top_ranks(ranks: DataFrame, most: int = 15) -> DataFrame:
    """The nodes of the highest PageRank with their place and share of the largest; only these meet in one window."""
    top = ranks.orderBy(F.desc("pagerank"), "node").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pagerank"), "node")))


def fix_lists(pages: DataFrame, least_words: int = 300) -> DataFrame:
    """One row a page and fault among pages of status 200: no_h1, multi_h1 (with the count), low_word_count (with the words, fewest first within the site)."""
    own = pages.where("status = 200") if "status" in pages.columns else pages
    h1, words = F.coalesce("h1_count", F.lit(0)), F.coalesce("word_count", F.lit(0))
    faults = F.array_compact(
        F.array(
            F.when(h1 == 0, F.struct(F.lit("no_h1").alias("fault"), h1.alias("value"))),
            F.when(h1 > 1, F.struct(F.lit("multi_h1").alias("fault"), h1.alias("value"))),
            F.when(words < least_words, F.struct(F.lit("low_word_count").alias("fault"), words.alias("value"))),
        )
    )
    rows = own.select(U.site(F.col("url")).alias("site"), "url", F.explode(faults).alias("f")).select("site", "url", "f.*")
    place = F.row_number().over(Window.partitionBy("site", "fault").orderBy("value", "url"))
    return rows.withColumn("place", place)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Pages of every site by a column's value, say page_type."""
    return rows.groupBy(U.site(F.col("url")).alias("site"), F.col(column).alias("value")).agg(F.count("*").alias("pages"))
