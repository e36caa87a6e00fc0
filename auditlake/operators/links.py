"""Link operators over anchor rows (page_id, url, pos, href, target, anchor)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U

#: Anchor texts that say nothing about their target.
GENERIC = (
    "klik hier", "klik", "hier", "klik dan hier", "druk hier", "klik op", "lees meer", "meer", "lees verder", "verder",
    "meer lezen", "verder lezen", "meer info", "meer informatie", "info", "informatie", "lees", "meer details", "bekijk",
    "bekijk hier", "bekijken", "details", "ga naar", "ga verder", "open", "link", "deze link", "via deze link", "website",
    "klik voor meer", "download", "volgende", "vorige", "terug", "start", "hier klikken", "read more", "click here",
    "click", "here", "more", "learn more", "this", "this page", "this link", "go", "view", "view more", "see more",
    "see all", "continue", "continue reading", "find out more", "next", "previous", "back", "go here", "full story",
    "get started",
)
#: The narrower list of the link optimiser.
GENERIC_CONTEXT = (
    "lees meer", "lees verder", "meer lezen", "verder lezen", "klik hier", "klik", "hier", "meer info",
    "meer informatie", "meer", "bekijk", "bekijken", "bekijk hier", "deze pagina", "link", "ga naar", "verder",
    "ontdek meer", "meer weten", "read more", "click here", "hier klikken", "dit artikel", "zie hier", "kijk hier",
)


def web(anchors: DataFrame) -> DataFrame:
    return anchors.where(F.col("target").rlike("^https?://"))


def is_internal(target: Column, url: Column) -> Column:
    return U.site(target) == U.site(url)


def outlinks(anchors: DataFrame) -> DataFrame:
    """Per page: links, distinct targets, internal and external links, empty anchors."""
    internal = is_internal(F.col("target"), F.col("url"))
    return web(anchors).groupBy("page_id").agg(
        F.count("*").alias("links"),
        F.countDistinct("target").alias("targets"),
        F.sum(internal.cast("int")).alias("internal"),
        F.sum((~internal).cast("int")).alias("external"),
        F.sum((F.col("anchor") == "").cast("int")).alias("empty_anchors"),
    )


def external_links(anchors: DataFrame, most: int = 200) -> DataFrame:
    """Per page and external target: the first non-empty anchor, by first position, the first `most` targets a page."""
    rows = web(anchors).where(~is_internal(F.col("target"), F.col("url")))
    by = rows.groupBy("page_id", "target").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("anchor", F.when(F.col("anchor") != "", F.col("pos"))).alias("anchor"),
        F.count("*").alias("uses"),
    )
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("first_pos"))
    return by.withColumn("place", place).where(F.col("place") <= most).drop("place")


def top_anchors(anchors: DataFrame, most: int = 60) -> DataFrame:
    rows = anchors.where("anchor <> ''").select(F.lower(F.substring("anchor", 1, 80)).alias("anchor"), "page_id")
    by = rows.groupBy("anchor").agg(F.count("*").alias("uses"), F.countDistinct("page_id").alias("pages"))
    return by.orderBy(F.desc("uses"), "anchor").limit(most)


def anchor_quality(anchors: DataFrame) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("anchor"), "[^a-zà-ÿ0-9 ]", ""))
    empty, generic = F.col("anchor") == "", key.isin(*GENERIC)
    count = lambda test, name: F.sum(test.cast("int")).alias(name)
    return anchors.groupBy("page_id").agg(
        F.count("*").alias("anchors"), count(empty, "empty"), count(generic, "generic"), count(empty | generic, "non_descriptive")
    )


def sampled(anchors: DataFrame, most: int = 40) -> DataFrame:
    """Distinct targets of a page, internal and external in turn, the first `most`: the links that a checker visits."""
    rows = web(anchors).withColumn("internal", is_internal(F.col("target"), F.col("url")))
    first = rows.groupBy("page_id", "target", "internal").agg(F.min("pos").alias("pos"))
    turn = F.row_number().over(Window.partitionBy("page_id", "internal").orderBy("pos"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("turn", F.desc("internal")))
    return first.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= most)


def checked(sample: DataFrame, url_checks: DataFrame) -> DataFrame:
    """Sampled links with their probe: broken (status from 400 or an error) or redirect (3xx)."""
    probes = url_checks.select(F.col("url").alias("_u"), "status", "error", "location")
    joined = sample.join(probes, F.col("target") == F.col("_u"), "left").drop("_u")
    return joined.withColumn("broken", F.coalesce((F.col("status") >= 400) | F.col("error").isNotNull(), F.lit(False))).withColumn(
        "redirect", F.coalesce(F.col("status").between(300, 399), F.lit(False))
    )
