"""Weighted page and site scores.

A category is a list of checks, each with a weight inside the category, a ratio from 0 to 1 and perhaps an issue.
Everything is a column expression over one row, but for the uniqueness of titles and descriptions, which is a
count per value, and the site roll-up, which is grouped aggregation over exploded breakdowns and issues.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from . import pages as P

SEVERITIES = ("Critical", "High", "Medium", "Low")

#: Inputs of the score and their types; a missing column counts as null.
INPUTS = {
    "url": "string", "title": "string", "title_cut": "boolean", "description": "string", "h1_count": "int",
    "empty_headings": "int", "headings_jump": "boolean", "indexable": "boolean", "canonical": "string",
    "canonical_conflict": "boolean", "word_count": "int", "thin": "boolean", "placeholder": "boolean", "flesch": "double",
    "n_jsonld_types": "int", "n_schemas": "int", "n_bad_schemas": "int", "fabricated_rating": "boolean",
    "n_rich_results": "int", "image_count": "int", "images_missing_alt": "int", "images_missing_dimensions": "int",
    "images_old_format": "int", "images_broken": "int", "n_broken_links": "int", "n_internal_links": "int",
    "n_unsafe_links": "int", "n_vague_anchors": "int", "hsts": "boolean", "x_content_type_options": "boolean",
    "x_frame_options": "boolean", "referrer_policy": "boolean", "compression": "string", "has_caching": "boolean",
    "mixed_content": "int", "ttfb_ms": "double", "psi": "boolean", "lcp": "double", "inp": "double", "cls": "double",
    "has_product": "boolean", "has_price": "boolean", "has_availability": "boolean", "has_gtin": "boolean",
    "has_brand": "boolean", "merchant_ready": "boolean",
}


@dataclass(frozen=True)
class Compat:
    """Ways in which the rules can follow earlier reports instead of their intent."""

    compression_none_counts: bool = False  # "none" as a compression passes
    web_vitals_unread: bool = False  # field data that wasn't read: 0.6, 0.6 and 1


@dataclass(frozen=True)
class Check:
    weight: float
    ratio: Column
    severity: Column | None = None
    code: str = ""
    title: Column | None = None
    when: Column = field(default_factory=lambda: F.lit(True))  # registered at all


@dataclass(frozen=True)
class Category:
    key: str
    weight: float
    checks: tuple[Check, ...]
    applicable: Column = field(default_factory=lambda: F.lit(True))


def grade(score: Column) -> Column:
    out = F.when(score.isNull(), "?")
    for low, name in ((90, "A"), (80, "B"), (70, "C"), (60, "D"), (50, "E")):
        out = out.when(score >= low, name)
    return out.otherwise("F")


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _passed(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def _steps(value: Column, *steps: tuple[float, float], other: float) -> Column:
    """The ratio of the first upper limit that value doesn't pass."""
    out = None
    for limit, ratio in steps:
        out = (out.when if out is not None else F.when)(value <= limit, ratio)
    return out.otherwise(other)


def _failing(test: Column, severity: str) -> Column:
    return F.when(test, F.lit(severity))


def _share(part: str, whole: str = "image_count") -> Column:
    return F.lit(1.0) - F.least(F.lit(1.0), _n(part) / F.greatest(F.lit(1), _n(whole)))


def title_checks(df: DataFrame) -> DataFrame:
    """Adds copies (rows of equal title on the same site), title_cut and ratio, the title category alone."""
    wide = F.expr(f"{T.pixel_width('title', T.TITLE_FONT)} > {T.TITLE_LIMIT}")
    own = df.withColumn("title_cut", wide)
    own = _copies(own, "title", "copies").withColumn("title_copies", F.col("copies"))
    category = next(c for c in categories(Compat()) if c.key == "title")
    return own.withColumn("ratio", _ratio(category))


def _copies(df: DataFrame, name: str, out: str) -> DataFrame:
    """Rows of the same site with an equal value, 1 for those without one.

    Counted by hash aggregation and joined back: a common value isn't gathered in one window partition, and rows without a
    value, which may be most, are dealt out by a salt.
    """
    key, site, salt = f"_{name}_key", f"_{name}_site", f"_{name}_salt"
    own = df.withColumn(key, F.coalesce(F.lower(F.trim(name)), F.lit(""))).withColumn(site, U.site(F.col("url")))
    own = own.withColumn(salt, F.when(F.col(key) == "", F.pmod(F.xxhash64("url"), F.lit(1024)) + 1).otherwise(F.lit(0)))
    counts = own.where(f"{key} <> ''").groupBy(site, key, salt).agg(F.count("*").alias(out)).where(f"{out} > 1")
    return own.join(counts, [site, key, salt], "left").withColumn(out, F.coalesce(out, F.lit(1).cast("long"))).drop(key, site, salt)


def categories(compat: Compat) -> tuple[Category, ...]:
    title, length = F.trim(F.coalesce("title", F.lit(""))), F.length(F.trim(F.coalesce("title", F.lit(""))))
    has_title = title != ""
    meta, meta_length = F.trim(F.coalesce("description", F.lit(""))), F.length(F.trim(F.coalesce("description", F.lit(""))))
    words, h1 = _n("word_count"), _n("h1_count")
    thin = F.coalesce(F.col("thin"), words < 200)
    compression = F.coalesce("compression", F.lit(""))
    packed = compression != "" if compat.compression_none_counts else ~F.lower(compression).isin("", "none")
    headers = ("hsts", "x_content_type_options", "x_frame_options", "referrer_policy")
    present = sum((_yes(h).cast("int") for h in headers), F.lit(0))
    unread = compat.web_vitals_unread
    lcp, inp, cls = (F.lit(0.0) if unread else F.coalesce(F.col(k), F.lit(0.0)) for k in ("lcp", "inp", "cls"))
    ttfb, links, vague = F.coalesce("ttfb_ms", F.lit(0.0)), _n("n_internal_links"), _n("n_vague_anchors")
    schemas, bad, typed = _n("n_schemas"), _n("n_bad_schemas"), _n("n_jsonld_types") > 0
    flesch = F.col("flesch")
    readable = F.when(flesch.isNull(), 0.7).when(flesch.between(30, 80), 1.0).when(flesch.between(20, 90), 0.5).otherwise(0.2)
    short = length < 30
    cut = _yes("title_cut")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    secure = F.coalesce(U.scheme(F.col("url")) == "https", F.lit(False))
    return (
        Category("title", 14, (
            Check(0.45, _passed(has_title), _failing(~has_title, "Critical"), "title_missing", F.lit("Title is missing")),
            Check(0.30, F.when(length.between(30, 60), 1.0).when(length.between(15, 70), 0.5).otherwise(0.0),
                  F.when(short | cut | (length > 60), "Medium"), "title_length",
                  text(F.when(short, "Title too short (").otherwise("Title cut off in results ("), length, " characters)"), has_title),
            Check(0.15, _passed(F.coalesce("title_copies", F.lit(1)) <= 1), _failing(F.coalesce("title_copies", F.lit(1)) > 1, "High"),
                  "title_duplicate", F.lit("Title isn't unique"), has_title),
            Check(0.10, _passed(~cut), when=has_title),
        )),
        Category("meta_description", 9, (
            Check(0.50, _passed(meta != ""), _failing(meta == "", "High"), "description_missing", F.lit("Meta description is missing")),
            Check(0.30, F.when(meta_length.between(70, 160), 1.0).when(meta_length.between(50, 175), 0.5).otherwise(0.0),
                  _failing(~meta_length.between(70, 160), "Medium"), "description_length",
                  text("Meta description length (", meta_length, " characters)"), meta != ""),
            Check(0.20, _passed(F.coalesce("description_copies", F.lit(1)) <= 1),
                  _failing(F.coalesce("description_copies", F.lit(1)) > 1, "Medium"), "description_duplicate",
                  F.lit("Meta description isn't unique"), meta != ""),
        )),
        Category("headings", 9, (
            Check(0.50, F.when(h1 == 1, 1.0).when(h1 == 0, 0.0).otherwise(0.3), F.when(h1 == 0, "Critical").when(h1 > 1, "High"),
                  "h1_count", F.when(h1 == 0, F.lit("No H1")).otherwise(text(h1, " H1 headings"))),
            Check(0.25, F.when(_n("empty_headings") > 0, 0.4).otherwise(1.0), _failing(_n("empty_headings") > 0, "Low"),
                  "headings_empty", text(_n("empty_headings"), " empty headings")),
            Check(0.25, F.when(_yes("headings_jump"), 0.4).otherwise(1.0), _failing(_yes("headings_jump"), "Low"),
                  "headings_jump", F.lit("Heading levels aren't sequential")),
        )),
        Category("indexability", 12, (
            Check(0.40, _passed(F.coalesce("indexable", F.lit(True))), _failing(~F.coalesce("indexable", F.lit(True)), "Critical"),
                  "not_indexable", F.lit("Page can't be indexed")),
            Check(0.20, _passed(secure), _failing(~secure, "Critical"), "not_https", F.lit("Page isn't served over HTTPS")),
            Check(0.20, _passed(F.coalesce("canonical", F.lit("")) != ""), _failing(F.coalesce("canonical", F.lit("")) == "", "Medium"),
                  "canonical_missing", F.lit("No canonical link")),
            Check(0.20, _passed(~_yes("canonical_conflict")), _failing(_yes("canonical_conflict"), "High"),
                  "canonical_conflict", F.lit("Canonical conflicts")),
        )),
        Category("content", 12, (
            Check(0.40, _passed(~(thin | (words < 200))), _failing(thin | (words < 300), "High"), "thin", text("Thin content (", words, " words)")),
            Check(0.30, F.when(words >= 800, 1.0).when(words >= 300, F.lit(0.6) + F.lit(0.4) * (words - 300) / F.lit(500.0)).otherwise(words / F.lit(300.0))),
            Check(0.15, _passed(~_yes("placeholder")), _failing(_yes("placeholder"), "High"), "placeholder", F.lit("Placeholder text")),
            Check(0.15, readable, _failing(flesch.isNotNull() & (readable < 1), "Low"), "readability",
                  text("Reading ease out of range (", F.round(flesch, 1), ")")),
        )),
        Category("structured_data", 11, (
            Check(0.35, _passed(typed), _failing(~typed, "Medium"), "no_jsonld", F.lit("No JSON-LD")),
            Check(0.30, F.when(schemas > 0, F.lit(1.0) - F.least(F.lit(1.0), bad / schemas)).otherwise(1.0), _failing(bad > 0, "High"),
                  "schema_invalid", text(bad, " incomplete schema types")),
            Check(0.20, _passed(~_yes("fabricated_rating")), _failing(_yes("fabricated_rating"), "Critical"),
                  "rating_fabricated", F.lit("Rating without visible reviews")),
            Check(0.15, F.when(_n("n_rich_results") > 0, 1.0).when(typed, 0.5).otherwise(0.0)),
        )),
        Category("images", 8, (
            Check(0.40, _share("images_missing_alt"), _failing(_n("images_missing_alt") > 0, "Medium"), "images_alt",
                  text(_n("images_missing_alt"), " of ", _n("image_count"), " images without alt")),
            Check(0.20, _share("images_missing_dimensions"), _failing(_n("images_missing_dimensions") > 0, "Low"), "images_dimensions",
                  text(_n("images_missing_dimensions"), " images without dimensions")),
            Check(0.20, _share("images_old_format"), _failing(_n("images_old_format") > 0, "Low"), "images_format",
                  text(_n("images_old_format"), " images in old formats")),
            Check(0.20, _passed(_n("images_broken") == 0), _failing(_n("images_broken") > 0, "High"), "images_broken",
                  text(_n("images_broken"), " broken images")),
        ), _n("image_count") > 0),
        Category("links", 8, (
            Check(0.40, _passed(_n("n_broken_links") == 0), _failing(_n("n_broken_links") > 0, "High"), "links_broken",
                  text(_n("n_broken_links"), " broken links")),
            Check(0.25, F.least(F.lit(1.0), links / F.lit(3.0)), _failing(links < 3, "Medium"), "links_few", text("Few internal links (", links, ")")),
            Check(0.20, _passed(_n("n_unsafe_links") == 0), _failing(_n("n_unsafe_links") > 0, "Low"), "links_unsafe",
                  text(_n("n_unsafe_links"), " links to a new window without noopener")),
            Check(0.15, F.greatest(F.lit(0.0), F.lit(1.0) - vague / F.lit(10.0)), _failing(vague > 0, "Low"), "anchors_vague",
                  text(vague, " anchors that don't describe")),
        )),
        Category("technical", 9, (
            Check(0.35, present / F.lit(4.0), _failing(present < 4, "Low"), "security_headers", F.lit("Security headers missing")),
            Check(0.20, _passed(packed), _failing(~packed, "Medium"), "compression", F.lit("No compression")),
            Check(0.15, _passed(_yes("has_caching")), _failing(~_yes("has_caching"), "Low"), "caching", F.lit("No cache headers")),
            Check(0.20, _passed(_n("mixed_content") == 0), _failing(_n("mixed_content") > 0, "High"), "mixed_content",
                  text(_n("mixed_content"), " insecure resources")),
            Check(0.10, _steps(ttfb, (0, 0.8), (200, 1.0), (600, 0.7), (1200, 0.4), other=0.1), _failing(ttfb > 800, "Medium"),
                  "slow_response", text("Slow response (", ttfb.cast("int"), " ms)")),
        )),
        Category("cwv", 8, (
            Check(0.34, F.when(lcp == 0, 0.6).otherwise(_steps(lcp, (2500, 1.0), (4000, 0.5), other=0.1)), _failing(lcp > 2500, "High"),
                  "lcp", text("Slow largest paint (", lcp.cast("int"), " ms)")),
            Check(0.33, F.when(inp == 0, 0.6).otherwise(_steps(inp, (200, 1.0), (500, 0.5), other=0.1)), _failing(inp > 200, "High"),
                  "inp", text("Slow interaction (", inp.cast("int"), " ms)")),
            Check(0.33, _steps(cls, (0.1, 1.0), (0.25, 0.5), other=0.1), _failing(cls > 0.1, "High"), "cls", text("Layout shift (", F.round(cls, 3), ")")),
        ), _yes("psi") & (F.lit(True) if unread else F.coalesce("lcp", "inp", "cls").isNotNull())),
        Category("ecommerce", 8, tuple(
            Check(w, _passed(_yes(name)), _failing(~_yes(name), severity), f"no_{name[4:] if name[:4] == 'has_' else name}", F.lit(said))
            for w, name, severity, said in (
                (0.30, "has_price", "High", "Product without a price"), (0.20, "has_availability", "Medium", "Product without availability"),
                (0.20, "has_gtin", "Medium", "Product without a GTIN"), (0.15, "has_brand", "Low", "Product without a brand"),
                (0.15, "merchant_ready", "Medium", "Not ready for a merchant listing"),
            )
        ), _yes("has_product")),
    )


def _clamped(ratio: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0))))


def _ratio(c: Category) -> Column:
    weigh = lambda value: sum((F.when(k.when, F.lit(k.weight) * value(k)).otherwise(F.lit(0.0)) for k in c.checks), F.lit(0.0))
    return weigh(lambda k: _clamped(k.ratio)) / weigh(lambda k: F.lit(1.0))


def _issues(c: Category, lost: Column) -> Column:
    rows = F.array(
        *[
            F.when(
                c.applicable & k.when & k.severity.isNotNull() & (_clamped(k.ratio) < 0.999),
                F.struct(k.severity.alias("severity"), F.lit(c.key).alias("category"), F.lit(k.code).alias("code"), k.title.alias("title")),
            )
            for k in c.checks
            if k.severity is not None
        ]
    )
    kept = F.array_compact(rows)
    each = F.round(lost / F.size(kept), 2)
    return F.transform(kept, lambda x: F.struct(x["severity"].alias("severity"), x["category"].alias("category"), x["code"].alias("code"), x["title"].alias("title"), F.when(lost > 0, each).alias("impact")))


def prepared(df: DataFrame) -> DataFrame:
    """All inputs, null where df has none, and the number of the site's rows of equal title and description."""
    own = df.select("*", *[F.lit(None).cast(kind).alias(k) for k, kind in INPUTS.items() if k not in df.columns])
    for name in ("title", "description"):
        own = _copies(own, name, f"{name}_copies")
    return own


def score(df: DataFrame, compat: Compat = Compat()) -> DataFrame:
    """df with breakdown, issues (worst first), score, grade and the issue counts."""
    found = categories(compat)
    own = prepared(df)
    own = own.select("*", *[_ratio(c).alias(f"_r_{c.key}") for c in found])
    earned = {c.key: F.round(F.col(f"_r_{c.key}") * c.weight, 2) for c in found}
    info = [
        F.struct(
            F.lit(c.key).alias("key"),
            F.lit(float(c.weight)).alias("weight"),
            c.applicable.alias("applicable"),
            F.round(F.col(f"_r_{c.key}"), 3).alias("ratio"),
            earned[c.key].alias("earned"),
            F.round(F.lit(float(c.weight)) - earned[c.key], 2).alias("lost"),
        )
        for c in found
    ]
    issues = F.flatten(F.array(*[_issues(c, F.lit(float(c.weight)) - earned[c.key]) for c in found]))
    own = own.select("*", F.array(*info).alias("breakdown"), issues.alias("_issues")).drop(*[f"_r_{c.key}" for c in found])
    rank = lambda x: F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), x["severity"])
    ranked = F.transform("_issues", lambda x, i: F.struct(rank(x).alias("r"), (-F.coalesce(x["impact"], F.lit(0.0))).alias("m"), i.alias("i"), x.alias("x")))
    total = lambda f: F.aggregate(F.filter("breakdown", lambda b: b["applicable"]), F.lit(0.0), lambda a, b: a + b[f])
    own = own.withColumn("issues", F.transform(F.array_sort(ranked), lambda s: s["x"])).drop("_issues")
    own = own.withColumn("points", F.round(total("earned"), 2)).withColumn("weight", F.round(total("weight"), 2))
    own = own.withColumn("score", F.round(100 * F.col("points") / F.col("weight"), 1)).withColumn("grade", grade(F.col("score")))
    count = lambda severity: F.size(F.filter("issues", lambda x: x["severity"] == severity))
    return own.withColumns({f"n_{s.lower()}": count(s) for s in SEVERITIES})


def from_pages(raw: DataFrame) -> DataFrame:
    """Scoring inputs that a table of raw pages gives by pattern."""
    own = P.head(raw)
    words = F.expr(T.words("text"))
    own = own.withColumn("_w", words)
    own = own.withColumn("word_count", F.greatest(F.lit(1), F.size("_w")).cast("int")).drop("_w")
    own = own.withColumn("title_cut", F.expr(f"{T.pixel_width('title', T.TITLE_FONT)} > {T.TITLE_LIMIT}"))
    links = P.anchors(raw).where(F.col("target").rlike("^https?://") & (U.site(F.col("target")) == U.site(F.col("url"))))
    links = links.groupBy(F.col("page_id").alias("_id")).agg(F.countDistinct("target").cast("int").alias("n_internal_links"))
    return own.withColumn("n_jsonld_types", F.col("jsonld_count")).join(links, F.col("page_id") == F.col("_id"), "left").drop("_id", "text")


def site_scores(scored: DataFrame) -> DataFrame:
    """Per site: pages, score, grade and the mean of every category's rounded ratios over the pages it applies to."""
    own = scored.select(U.site(F.col("url")).alias("site"), "score", "breakdown")
    total = own.groupBy("site").agg(F.count("score").alias("pages"), F.round(F.avg("score"), 1).alias("score"))
    parts = own.select("site", F.explode("breakdown").alias("b")).where("b.applicable")
    keys = [c.key for c in categories(Compat())]
    by = parts.groupBy("site").agg(*[F.round(100 * F.avg(F.when(F.col("b.key") == k, F.col("b.ratio"))), 1).alias(f"{k}_pct") for k in keys])
    return total.join(by, "site").withColumn("grade", grade(F.col("score")))


def top_issues(scored: DataFrame, most: int = 40, urls: int = 12) -> DataFrame:
    """Issues of equal severity and title over all pages, most severe and frequent first, with the first urls."""
    rows = scored.select("url", F.posexplode("issues").alias("pos", "x")).select("url", "pos", "x.*")
    by = rows.groupBy("severity", "title").agg(
        F.min("category").alias("category"), F.min("code").alias("code"), F.count("*").alias("pages"), F.min("url").alias("first_url")
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    top = by.orderBy(rank, F.desc("pages"), "title").limit(most)
    # Example urls only for the issues that stay: row_number keeps `urls` a group.
    place = F.row_number().over(Window.partitionBy("severity", "title").orderBy("url"))
    shown = rows.join(F.broadcast(top.select("severity", "title")), ["severity", "title"]).withColumn("n", place).where(F.col("n") <= urls)
    lists = shown.groupBy("severity", "title").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    return top.join(lists, ["severity", "title"])


def ranked_pages(scored: DataFrame, worst: int = 10, best: int = 5) -> DataFrame:
    low = scored.orderBy("score", "url").limit(worst).select(F.lit("worst").alias("list"), "url", "score", "grade")
    return low.unionByName(scored.orderBy(F.desc("score"), "url").limit(best).select(F.lit("best").alias("list"), "url", "score", "grade"))
