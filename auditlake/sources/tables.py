"""Sources other than Parquet: sitemaps, robots files, persisted runs, raw bytes."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sitemap(files: DataFrame) -> DataFrame:
    """(domain, xml) -> domain, url, pos: the <loc> entries, each url once in its first place."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    rows = files.select("domain", F.posexplode(locs).alias("pos", "url"))
    return rows.groupBy("domain", F.replace(F.col("url"), F.lit("&amp;"), F.lit("&")).alias("url")).agg(F.min("pos").alias("pos"))


def robots(files: DataFrame) -> DataFrame:
    """(host, robots_txt) -> host, sitemaps, crawl_delay (at most 10 s)."""
    maps = F.regexp_extract_all("robots_txt", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    delay = F.regexp_extract("robots_txt", r"(?im)^\s*crawl-delay:\s*([0-9.]+)", 1).try_cast("double")
    return files.select("host", maps.alias("sitemaps"), F.least(F.lit(10.0), delay).alias("crawl_delay"))


def allowed(pages: DataFrame, hosts: DataFrame, agent: str = "Googlebot") -> DataFrame:
    """pages (host, url) with `robots_allowed`; a host without robots.txt allows all."""

    @F.pandas_udf("boolean")
    def test(text: pd.Series, url: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        rules = {}
        for t in text.dropna().unique():
            rules[t] = RobotFileParser()
            rules[t].parse(t.splitlines())
        return pd.Series([True if t is None or t != t else rules[t].can_fetch(agent, u or "") for t, u in zip(text, url, strict=True)])

    joined = pages.join(hosts.select("host", "robots_txt"), "host", "left")
    return joined.withColumn("robots_allowed", test("robots_txt", "url")).drop("robots_txt")


def decoded(raw: bytes, content_type: str | None, most: int | None = None) -> tuple[str, str, str, bool]:
    """Text, encoding, where it was found and whether bytes were cut: header, byte-order mark, meta in the first 4 KB, else UTF-8.

    Whole pages are read unless `most` bytes are asked for.
    """
    cut = most is not None and len(raw) > most
    raw = raw[:most]
    marks = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
    header = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I)
    named = re.search(rb"charset=[\"']?([\w-]+)", raw[:4096], re.I)
    tries = [(header[1], "header")] if header else []
    tries += [(e, "bom") for mark, e in marks if raw.startswith(mark)]
    tries += [(named[1].decode("ascii"), "meta")] if named else []
    for encoding, source in tries:
        try:
            return raw.decode(encoding), codecs.lookup(encoding).name, source, cut
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace"), "utf-8", "fallback", cut


def sitemap_index(files: DataFrame, most: int = 10) -> DataFrame:
    """(domain, xml) -> domain, url, pos: the first `most` sitemaps that index files name, to be fetched as files of their own."""
    index = files.where(F.col("xml").rlike("(?i)<sitemapindex"))
    return sitemap(index).where(F.col("pos") < most)


def unpacked(files: DataFrame) -> DataFrame:
    """(domain, url, content) -> domain, url, xml: gzip by its first bytes or the name, anything else as it is."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        import gzip
        import zlib

        def one(raw):
            if raw is None:
                return None
            raw = bytes(raw)
            try:
                return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
            except (OSError, EOFError, zlib.error):
                return None

        return content.map(one)

    return files.select("domain", "url", run("content").alias("xml"))


def included(pages: DataFrame, pattern: str | None) -> DataFrame:
    """Pages whose url a pattern finds; all of them if there is no pattern, or none that can be read."""
    try:
        valid = pattern and re.compile(pattern)
    except re.error:
        valid = None
    return pages.where(F.col("url").rlike(pattern)) if valid else pages


def profile(domains: DataFrame, *layers: DataFrame, other: str = "generic") -> DataFrame:
    """domain -> profile: the first layer (domain, profile) that names it, from the most to the least specific, else `other`."""
    from ..functions import url as U

    out, found = domains.select("domain").distinct().withColumn("_key", U.domain(F.col("domain"))), []
    for k, layer in enumerate(layers):
        own = layer.groupBy(U.domain(F.col("domain")).alias("_key")).agg(F.min("profile").alias(f"_p{k}"))
        out, found = out.join(own, "_key", "left"), [*found, F.col(f"_p{k}")]
    return out.select("domain", F.coalesce(*found, F.lit(other)).alias("profile"))


def certificate_days(expires, today):
    """Days from a date to a certificate's end."""
    return F.datediff(F.to_date(expires), F.to_date(today))


def decode_pages(files: DataFrame) -> DataFrame:
    """(url, content, content_type) -> url, html, encoding, encoding_source, truncated."""

    @F.pandas_udf("html string, encoding string, encoding_source string, truncated boolean")
    def run(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoded(bytes(c), k) if c is not None else (None, None, None, None) for c, k in zip(content, kind, strict=True)], columns=["html", "encoding", "encoding_source", "truncated"])

    return files.select("url", run("content", "content_type").alias("d")).select("url", "d.*")


def persisted(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that sinks.write_run left in a folder."""
    names = ("pages", "products", "analysis", "scores", "sitemap")
    found = {}
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found[name] = spark.read.parquet(f"{folder}/{name}")
    return found
