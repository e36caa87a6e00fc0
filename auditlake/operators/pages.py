"""Page projections by pattern, for tables of raw HTML: head fields, headings, anchors, visible text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

NOISE = r"(?is)<!--.*?-->|<(script|style|noscript|svg)\b.*?</(script|style|noscript|svg)\s*>"
ANCHOR = r"(?is)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"


def unescaped(text: Column) -> Column:
    """The five common character references; &amp; last, so that nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t-\r]+", " "))


def head(pages: DataFrame) -> DataFrame:
    """page_id, url, title, title_length, lang, charset, doctype_html5, h1, h1_count, text, word_count of clean HTML."""
    clean = F.regexp_replace("html", NOISE, " ")
    first = lambda pattern: unescaped(collapsed(F.regexp_extract(clean, pattern, 1)))
    body = collapsed(unescaped(F.regexp_replace(F.regexp_replace(clean, r"(?is)<title\b.*?</title>", " "), r"<[^>]*>?", " ")))
    return pages.select(
        "page_id",
        "url",
        first(r"(?is)<title[^>]*>(.*?)</title>").alias("title"),
        F.regexp_extract("html", r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1).alias("lang"),
        F.lower(F.regexp_extract("html", r"(?i)<meta[^>]*\bcharset=\"?([a-z0-9-]+)", 1)).alias("charset"),
        (F.lower(F.regexp_extract("html", r"(?i)<!doctype\s+([^>]*)>", 1)) == "html").alias("doctype_html5"),
        first(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"),
        F.regexp_count(clean, F.lit(r"(?i)<h1\b")).alias("h1_count"),
        unescaped(F.regexp_extract(clean, r"(?is)<meta[^>]*name=\"description\"[^>]*content=\"([^\"]*)\"", 1)).alias("description"),
        F.regexp_extract(clean, r"(?is)<link[^>]*rel=\"canonical\"[^>]*href=\"([^\"]*)\"", 1).alias("canonical"),
        F.regexp_count("html", F.lit(r"(?i)application/ld\+json")).alias("jsonld_count"),
        F.regexp_count(clean, F.lit(r"(?i)<img\b")).alias("image_count"),
        body.alias("text"),
    ).withColumn("title_length", F.length("title"))


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, target (absolute for root-relative links), anchor text."""
    clean = F.regexp_replace("html", NOISE, " ")
    found = pages.select(
        "page_id",
        "url",
        F.arrays_zip(
            F.regexp_extract_all(clean, F.lit(ANCHOR), F.lit(1)).alias("href"),
            F.regexp_extract_all(clean, F.lit(ANCHOR), F.lit(2)).alias("inner"),
        ).alias("a"),
    )
    rows = found.select("page_id", "url", F.posexplode("a").alias("pos", "a")).select(
        "page_id",
        "url",
        "pos",
        F.trim(F.col("a.href")).alias("href"),
        collapsed(unescaped(F.regexp_replace("a.inner", r"<[^>]*>", " "))).alias("anchor"),
    )
    root = F.concat(U.scheme(F.col("url")), F.lit("://"), U.part(F.col("url"), 2))
    target = F.when(F.col("href").startswith("/") & ~F.col("href").startswith("//"), F.concat(root, F.col("href"))).otherwise(F.col("href"))
    return rows.withColumn("target", target)
