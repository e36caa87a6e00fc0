"""Queries for audits: contrast of derived colours, event windows, records parsed from HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import url as U
from ..operators import audits, records, scoring
from ..sources import html
from ..streaming import scoring as streams
from .catalog import query, table

_LIN = lambda v: f"(case when {v} / 255.0::double <= 0.03928 then {v} / 255.0::double / 12.92 else pow(({v} / 255.0::double + 0.055) / 1.055, 2.4) end)"
_HEX = lambda x, k: f"('0x' || substr({x}, {k}, 2))::int::double"
_LUM = lambda x: f"(0.2126 * {_LIN(_HEX(x, 2))} + 0.7152 * {_LIN(_HEX(x, 4))} + 0.0722 * {_LIN(_HEX(x, 6))})"


@query(f"""with c as (select p_partkey, '#' || substr(md5(p_name), 1, 6) fg, '#' || substr(md5(p_brand), 1, 6) bg from part),
l as (select *, {_LUM('fg')} a, {_LUM('bg')} b from c)
select p_partkey, fg, bg, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 2) ratio, (greatest(a, b) + 0.05) / (least(a, b) + 0.05) >= 4.5 passes from l""")
def contrast_pairs(spark, sf_dir):
    """Contrast of two colours derived from each part."""
    own = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6)).alias("fg"), F.concat(F.lit("#"), F.substring(F.md5("p_brand"), 1, 6)).alias("bg")
    )
    ratio = C.contrast(C.parsed(F.col("fg")), C.parsed(F.col("bg")))
    return own.select("p_partkey", "fg", "bg", F.round(ratio, 2).alias("ratio"), (ratio >= 4.5).alias("passes"))


@query("select date_trunc('day', ts)::timestamp window_start, event_type, count(*) n_events, round(sum(value), 4) total from events group by 1, 2")
def event_windows(spark, sf_dir):
    return streams.event_windows(table(spark, sf_dir, "events"))


def _records(spark, sf_dir):
    own = records.full(html.parsed(table(spark, sf_dir, "pages"))).withColumn("title", F.col("page.title"))
    named = F.size(F.filter("page.jsonld", lambda d: d.rlike(r'"@type":\s*\[?"Product(Group)?"'))) + F.size(F.filter("page.items", lambda i: F.lower(i["type"]) == "product"))
    return own.withColumn("page_type", U.page_type(F.col("url"), named, F.col("page.raw_text").rlike(audits.PRICE) & F.exists("page.ctas", lambda c: c["text"].rlike("(?i)winkelwagen|add to cart|in mand"))))


@query()
def page_records(spark, sf_dir):
    """The wide record's scalar fields after one parse of each page."""
    return _records(spark, sf_dir).select(
        "page_id", "title", "h1", "h1_count", "word_count", "flesch", "language_detected", "indexability_reason", "canonical_conflict", "n_internal_links",
        "external_links_count", "image_count", "images_missing_alt", "mixed_content", "citable", F.size("page.jsonld").alias("n_jsonld"), "content_md5",
    )


@query()
def record_scores(spark, sf_dir):
    """Scores from parsed records, all inputs that HTML alone gives."""
    return scoring.score(_records(spark, sf_dir)).select("page_id", "score", "grade", "n_critical", "n_high", "n_medium", "n_low")


@query()
def conversion_checks(spark, sf_dir):
    return audits.conversion_checks(_records(spark, sf_dir))


@query()
def audience_checks(spark, sf_dir):
    return audits.audience_checks(_records(spark, sf_dir))
