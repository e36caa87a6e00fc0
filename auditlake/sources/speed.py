"""Page-speed reports: the JSON of a run to its fields, by VARIANT paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field metrics and lab audits by their names in a report.
FIELD = {
    "lcp_field": "LARGEST_CONTENTFUL_PAINT_MS", "inp_field": "INTERACTION_TO_NEXT_PAINT", "cls_field": "CUMULATIVE_LAYOUT_SHIFT_SCORE",
    "fcp_field": "FIRST_CONTENTFUL_PAINT_MS", "ttfb_field": "EXPERIMENTAL_TIME_TO_FIRST_BYTE",
}
LAB = {
    "fcp": "first-contentful-paint", "lcp": "largest-contentful-paint", "tbt": "total-blocking-time", "speed_index": "speed-index",
    "tti": "interactive", "server_response_time": "server-response-time",
}
SCORES = {"performance_score": "performance", "seo_score": "seo", "accessibility_score": "accessibility", "best_practices_score": "best-practices"}


def _get(path: str, kind: str = "double") -> Column:
    return F.try_variant_get("v", path, kind)


def _audit(name: str, field: str = ".numericValue", kind: str = "double") -> Column:
    return _get(f"$.lighthouseResult.audits['{name}']{field}", kind)


def _whole(value: Column) -> Column:
    return F.bround(value).cast("long")


def _kb(value: Column) -> Column:
    return F.round(value / 1024, 1)


def _saved(name: str) -> Column:
    return _kb(F.coalesce(_audit(name, ".details.overallSavingsBytes"), _audit(name)))


def _category(path: str) -> Column:
    said = F.upper(_get(path, "string"))
    return F.when(said.isin("FAST", "GOOD"), "good").when(said.isin("AVERAGE", "NEEDS_IMPROVEMENT", "NI"), "ni").when(said.isin("SLOW", "POOR"), "poor")


def fields(reports: DataFrame) -> DataFrame:
    """(url, strategy, json) -> url, strategy, 5 field metrics, 15 lab values, 4 scores; null where a report lacks one."""
    own = reports.withColumn("v", F.try_parse_json("json"))
    metric = lambda k: f"$.loadingExperience.metrics['{k}']"
    size = _audit("total-byte-weight")
    return own.select(
        "url",
        "strategy",
        *[F.struct(_get(f"{metric(k)}.percentile").alias("percentile"), _category(f"{metric(k)}.category").alias("category")).alias(n) for n, k in FIELD.items()],
        *[_whole(_audit(k)).alias(n) for n, k in LAB.items()],
        F.round(_audit("cumulative-layout-shift"), 3).alias("cls"),
        size.cast("long").alias("total_byte_weight"),
        _kb(size).alias("page_size_total_kb"),
        F.size(_audit("network-requests", ".details.items", "array<variant>")).alias("network_requests"),
        F.struct(
            F.size(_audit("render-blocking-resources", ".details.items", "array<variant>")).alias("count"),
            _whole(F.coalesce(_audit("render-blocking-resources", ".details.overallSavingsMs"), _audit("render-blocking-resources"))).alias("ms"),
        ).alias("render_blocking_resources"),
        _saved("unused-css-rules").alias("unused_css_kb"),
        _saved("unused-javascript").alias("unused_js_kb"),
        (_audit("uses-text-compression", ".score") == 1).alias("uses_text_compression"),
        _audit("dom-size").cast("long").alias("dom_size"),
        *[_whole(_get(f"$.lighthouseResult.categories['{k}'].score") * 100).alias(n) for n, k in SCORES.items()],
    )


def vitals(reports: DataFrame) -> DataFrame:
    """Inputs of the score's web vitals: url, psi, lcp, inp, cls, field data before lab data."""
    own = fields(reports)
    lab = {"lcp": F.col("lcp").cast("double"), "inp": F.lit(None).cast("double"), "cls": F.col("cls")}
    scale = {"lcp": 1, "inp": 1, "cls": 100}  # a report gives the layout shift of real users in hundredths
    return own.select("url", F.lit(True).alias("psi"), *[F.coalesce(F.col(f"{k}_field.percentile") / scale[k], v).alias(k) for k, v in lab.items()])
