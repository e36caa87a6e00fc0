"""Operators on parsed page records: head, headings, links, images, structured data, commerce, citability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from .links import GENERIC

#: Required, one-of and recommended fields of schema types.
RULES = {
    "product": ("name", "offers review aggregateRating", "image description brand sku"), "offer": ("price priceCurrency availability", "", ""),
    "article": ("headline image datePublished author", "", ""), "newsarticle": ("headline image datePublished author", "", ""),
    "blogposting": ("headline image datePublished author", "", ""), "breadcrumblist": ("itemListElement", "", ""),
    "faqpage": ("mainEntity", "", ""), "qapage": ("mainEntity", "", ""), "organization": ("name", "", "logo url sameAs"),
    "localbusiness": ("name address", "", "telephone openingHours geo priceRange"), "review": ("itemReviewed reviewRating author", "", ""),
    "aggregaterating": ("ratingValue", "reviewCount ratingCount", ""), "videoobject": ("name description thumbnailUrl uploadDate", "", ""),
    "event": ("name startDate location", "", ""), "recipe": ("name image", "", "recipeIngredient recipeInstructions"),
    "person": ("name", "", ""), "website": ("name url", "", ""), "jobposting": ("title description datePosted hiringOrganization", "", ""),
}
#: Types that can give a rich result.
RICH = set(RULES) - {"offer"}
#: Security headers, social platforms, and robots of language models.
SECURITY = {
    "hsts": "strict-transport-security", "csp": "content-security-policy", "x_frame_options": "x-frame-options",
    "x_content_type_options": "x-content-type-options", "referrer_policy": "referrer-policy", "permissions_policy": "permissions-policy",
}
SOCIAL = {
    "facebook": r"facebook\.com", "instagram": r"instagram\.com", "x_twitter": r"(twitter|x)\.com", "linkedin": r"linkedin\.com",
    "youtube": r"youtube\.com|youtu\.be", "tiktok": r"tiktok\.com", "pinterest": r"pinterest\.", "whatsapp": r"wa\.me|whatsapp\.com",
}
AI_BOTS = ("GPTBot", "Google-Extended", "ClaudeBot", "anthropic-ai", "CCBot", "PerplexityBot", "Bytespider", "Applebot-Extended")
NEXT_GEN = ("webp", "avif", "jxl")


def meta(name: str) -> Column:
    return F.trim(F.element_at("page.metas", F.lit(name)))


def head(df: DataFrame) -> DataFrame:
    """Head fields: metas, Open Graph, robots directives, dates, pixel widths."""
    robots = F.lower(F.coalesce(meta("robots"), F.lit("")))
    # a robot's name before the colon goes, a directive's own colon stays
    parts = F.transform(F.split(robots, ","), lambda d: F.trim(F.regexp_replace(d, r"^\s*(?!max-|unavailable)[a-z-]+:\s*", "")))
    names = ("noindex", "nofollow", "noarchive", "nosnippet", "noimageindex", "notranslate", "indexifembedded")
    directives = [(F.array_contains(parts, n) | (F.array_contains(parts, "none") if n in ("noindex", "nofollow") else F.lit(False))).alias(n) for n in names]
    return df.select(
        "*",
        meta("description").alias("description"),
        meta("keywords").alias("meta_keywords"),
        meta("viewport").alias("viewport"),
        meta("author").alias("author"),
        meta("theme-color").alias("theme_color"),
        F.struct(*[meta(f"og:{k}").alias(k) for k in ("title", "description", "image", "type", "url", "site_name")]).alias("og"),
        F.struct(*[meta(f"twitter:{k}").alias(k) for k in ("card", "title", "description", "image")]).alias("twitter"),
        F.struct(*directives, F.regexp_extract(robots, r"max-snippet:\s*(-?\d+)", 1).alias("max_snippet")).alias("robots_directives"),
        (F.col("page.doctype") == "html").alias("doctype_html5"),
        F.coalesce(meta("article:published_time"), F.get_json_object(F.get("page.jsonld", F.lit(0)), "$.datePublished"), F.get("page.times", F.lit(0))).alias("publish_date"),
        F.coalesce(meta("article:modified_time"), F.get_json_object(F.get("page.jsonld", F.lit(0)), "$.dateModified")).alias("modified_date"),
    )


def headings(df: DataFrame) -> DataFrame:
    levels = F.col("page.headings.level")
    jump = F.exists(F.zip_with(levels, F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: b > a + 1), lambda x: F.coalesce(x, F.lit(False)))
    h1 = F.filter("page.headings", lambda h: h["level"] == 1)
    return df.select(
        "*",
        F.size(h1).alias("h1_count"),
        F.get(h1, F.lit(0))["text"].alias("h1"),
        F.exists(h1, lambda h: F.length(h["text"]) > 70).alias("h1_over_70"),
        F.size(F.filter("page.headings", lambda h: h["text"] == "")).alias("empty_headings"),
        F.when(F.size(levels) > 1, jump).otherwise(F.lit(False)).alias("headings_jump"),
    )


def content(df: DataFrame) -> DataFrame:
    words = F.expr(T.words("page.text"))
    own = df.select("*", words.alias("_w"), F.expr(T.sentence_count("page.text")).alias("sentences"))
    own = own.select(
        "*",
        F.greatest(F.lit(1), F.size("_w")).alias("word_count"),
        (F.size("_w") < 200).alias("thin"),
        F.expr(T.language("_w")).alias("language_detected"),
        T.placeholder("page.text").alias("placeholder"),
        F.md5("page.main_text").alias("content_md5"),
        F.length("page.main_text").alias("normalized_text_length"),
        F.round(F.size("_w") / F.col("sentences"), 1).alias("avg_words_per_sentence"),
        F.expr(f"cast(aggregate(_w, 0, (a, w) -> a + {T.syllables('w')}) as long)").alias("_y"),
    )
    own = own.withColumn("flesch", F.expr(T.flesch("size(_w)", "sentences", "_y", "language_detected")))
    own = own.withColumn("readability_class", F.expr(T.reading_class("flesch")))
    matches = F.when(F.col("language_detected").isNotNull() & (F.coalesce("page.lang", F.lit("")) != ""), F.lower(F.substring("page.lang", 1, 2)) == F.col("language_detected"))
    return own.withColumn("language_matches_attr", matches).drop("_w", "_y")


def links(df: DataFrame) -> DataFrame:
    web = F.filter("page.links", lambda x: x["target"].rlike("^https?://") & ~x["href"].startswith("#"))
    same = lambda x: U.site(x["target"]) == U.site(F.col("url"))
    key = lambda x: F.trim(F.regexp_replace(F.lower(x["text"]), "[^a-zà-ÿ0-9 ]", ""))
    own = df.withColumn("_web", web)
    count = lambda test: F.size(F.filter("_web", test))
    return own.select(
        "*",
        F.size("_web").alias("outlink_count"),
        F.array_sort(F.array_distinct(F.transform(F.filter("_web", same), lambda x: x["target"]))).alias("internal_links"),
        count(lambda x: ~same(x)).alias("external_links_count"),
        F.struct(*[count(_has(r)).alias(r) for r in ("nofollow", "sponsored", "ugc", "noopener", "noreferrer")]).alias("link_rel_summary"),
        F.array_distinct(F.transform(F.filter("_web", lambda x: x["blank"] & ~F.array_contains(x["rel"], "noopener") & ~F.array_contains(x["rel"], "noreferrer")), lambda x: x["target"])).alias("_unsafe"),
        count(lambda x: (x["text"] == "") | key(x).isin(*GENERIC)).alias("n_vague_anchors"),
    ).withColumn("n_internal_links", F.size("internal_links")).withColumn("n_unsafe_links", F.size("_unsafe")).withColumn("unsafe_cross_origin", F.slice("_unsafe", 1, 100)).drop("_web", "_unsafe")


def _has(rel: str):
    return lambda x: F.array_contains(x["rel"], rel)


def extension(src: Column) -> Column:
    return F.lower(F.regexp_extract(U.path(src), r"\.([A-Za-z0-9]{2,5})$", 1))


def images(df: DataFrame) -> DataFrame:
    """Two counters on purpose: image_count leaves out images in noscript, the summary doesn't."""
    visible = F.filter("page.images", lambda i: ~i["in_noscript"])
    count = lambda test: F.size(F.filter("page.images", test))
    old = lambda i: ~extension(i["src"]).isin("", "svg", *NEXT_GEN)
    backgrounds = F.flatten(F.transform("page.styles", lambda s: F.regexp_extract_all(s, F.lit(r"""url\(\s*['"]?([^'")]+)"""), F.lit(1))))
    return df.select(
        "*",
        F.size(visible).alias("image_count"),
        F.size(F.filter(visible, lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) == "")).alias("images_missing_alt"),
        F.struct(
            F.size("page.images").alias("total"),
            count(lambda i: i["alt"].isNull()).alias("missing_alt"),
            count(lambda i: i["width"].isNull() | i["height"].isNull()).alias("missing_dimensions"),
            count(old).alias("non_next_gen"),
            count(lambda i: i["loading"] == "lazy").alias("lazy"),
            count(lambda i: i["srcset"]).alias("responsive"),
        ).alias("images_summary"),
        F.slice(F.array_distinct(backgrounds), 1, 60).alias("background_images"),
        F.transform(F.filter("page.images", lambda i: F.concat_ws(" ", i["src"], i["alt"]).rlike("(?i)logo|brand|merk")), lambda i: i["src"]).alias("logo_candidates"),
    )


def technical(df: DataFrame) -> DataFrame:
    """Response facts from status, headers (lower-cased names) and redirect_chain, where the table has them."""
    own = df
    for name, kind in (("status", "int"), ("headers", "map<string,string>"), ("redirect_chain", "array<struct<status:int,url:string>>"), ("robots_allowed", "boolean"), ("ms", "long")):
        if name not in own.columns:
            own = own.withColumn(name, F.lit(None).cast(kind))
    header = lambda k: F.element_at("headers", F.lit(k))
    robots = F.lower(F.concat_ws(" ", meta("robots"), meta("googlebot"), header("x-robots-tag")))
    noindex = robots.contains("noindex") | robots.contains("none")
    canonical = F.coalesce("page.canonical", F.lit(""))
    away = (canonical != "") & (U.canonical_key(canonical) != U.canonical_key(F.col("url")))
    og = F.coalesce(meta("og:url"), F.lit(""))
    status = F.coalesce("status", F.lit(200))
    insecure = F.filter("page.resources", lambda s: s.startswith("http://") | s.startswith("//"))
    secure = U.scheme(F.col("url")) == "https"
    cache = F.lower(F.coalesce(header("cache-control"), F.lit("")))
    reason = (
        F.when((status == 0) | (status >= 400), "error").when(status.between(300, 399), "redirect")
        .when(~F.coalesce("robots_allowed", F.lit(True)), "blocked").when(noindex, "noindex").when(away, "canonicalised").otherwise("ok")
    )
    return own.select(
        "*",
        reason.alias("indexability_reason"),
        (reason == "ok").alias("indexable"),
        canonical.alias("canonical"),
        (away | ((canonical != "") & (og != "") & (U.canonical_key(canonical) != U.canonical_key(og))) | (noindex & (canonical != ""))).alias("canonical_conflict"),
        F.when(secure, F.size(insecure)).otherwise(0).alias("mixed_content"),
        F.slice(F.array_distinct(insecure), 1, 100).alias("mixed_content_list"),
        *[F.coalesce(header(v) != "", F.lit(False)).alias(k) for k, v in SECURITY.items()],
        F.coalesce(F.lower(header("content-encoding")), F.lit("none")).alias("compression"),
        ((cache != "") & ~cache.contains("no-store") | header("etag").isNotNull() | header("expires").isNotNull()).alias("has_caching"),
        F.coalesce(F.size("redirect_chain"), F.lit(0)).alias("redirect_count"),
        F.coalesce(U.redirect_loop(F.col("redirect_chain.url")), F.lit(False)).alias("redirect_loop"),
        F.when(header("cf-ray").isNotNull(), "cloudflare").when(header("x-vercel-id").isNotNull(), "vercel").when(header("x-amz-cf-id").isNotNull(), "cloudfront")
        .when(header("x-served-by").contains("cache"), "fastly").when(F.lower(header("server")).contains("akamai"), "akamai").alias("cdn_detected"),
        F.col("ms").cast("double").alias("ttfb_ms"),
    )


NODE = "array<struct<pos:int,type:string,keys:array<string>,json:string>>"


def _walk(doc: str):
    import json

    out, stack = [], [json.loads(doc)]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            kind = node.get("@type")
            filled = [k for k, v in node.items() if v not in (None, "", [], {})]
            for t in kind if isinstance(kind, list) else [kind]:
                if t:
                    out.append((str(t).lower(), filled, json.dumps(node, ensure_ascii=False)))
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))
    return out


def nodes(df: DataFrame, key: str) -> DataFrame:
    """JSON-LD nodes in pre-order: key, url, pos, type (lower case), keys with a value, json."""
    from collections.abc import Iterator

    import pyarrow as pa

    from ..shipping import ship

    ship(df.sparkSession)
    docs = df.select(F.col(key).cast("string").alias("key"), "url", F.col("page.jsonld").alias("docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, u, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(k, u, n, *x) for n, x in enumerate(x for d in found or [] for x in _walk(d))]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["key", "url", "pos", "type", "keys", "json"])

    return docs.mapInArrow(run, "key string, url string, pos int, type string, keys array<string>, json string")


def validated(found: DataFrame) -> DataFrame:
    """Nodes of a known type with missing fields and a status: invalid, warning or valid."""
    spark = found.sparkSession
    rules = spark.createDataFrame([(k, *[x.split() for x in v]) for k, v in RULES.items()], "type string, required array<string>, one_of array<string>, recommended array<string>")
    own = found.join(F.broadcast(rules), "type")
    missing = F.array_except("required", "keys")
    one = (F.size("one_of") > 0) & ~F.arrays_overlap("one_of", "keys")
    questions = F.get_json_object("json", "$.mainEntity[*].acceptedAnswer.text")
    faq = (F.col("type") == "faqpage") & ~F.array_contains(missing, "mainEntity") & questions.isNull() & F.get_json_object("json", "$.mainEntity.acceptedAnswer.text").isNull()
    own = own.withColumn("missing", F.when(one, F.concat(missing, F.array(F.concat_ws("|", "one_of")))).otherwise(missing))
    own = own.withColumn("missing", F.when(faq, F.concat("missing", F.array(F.lit("acceptedAnswer")))).otherwise(F.col("missing")))
    own = own.withColumn("advised", F.array_except("recommended", "keys"))
    status = F.when(F.size("missing") > 0, "invalid").when(F.size("advised") > 0, "warning").otherwise("valid")
    return own.select("key", "url", "type", "missing", "advised", status.alias("status")).distinct()


def rich_results(found: DataFrame, checked: DataFrame) -> DataFrame:
    """Types of a page that can give a rich result; WebSite only with a search action."""
    search = found.where("type = 'website' and json like '%SearchAction%'").select("key", "type").distinct()
    fit = checked.where(F.col("type").isin(*RICH) & (F.col("status") != "invalid")).select("key", "type").distinct()
    return fit.where("type <> 'website'").unionByName(fit.where("type = 'website'").join(search, ["key", "type"], "left_semi"))


def invalid_types(checked: DataFrame) -> DataFrame:
    """Per invalid type: the union of missing fields and the number of pages."""
    return checked.where("status = 'invalid'").groupBy("type").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing")))).alias("missing"), F.countDistinct("url").alias("pages")
    )


def number(text: Column) -> Column:
    """1.234,56 and 1,234.56 alike; null if there is none."""
    bare = F.regexp_replace(text, r"[^0-9.,-]", "")
    comma = F.length(bare) - F.length(F.regexp_replace(bare, ".*,", "")) > F.length(bare) - F.length(F.regexp_replace(bare, r".*\.", ""))
    european = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    thousands = bare.rlike(r"^-?\d{1,3}(\.\d{3})+$")
    plain = F.replace(F.when(thousands, F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare), F.lit(","), F.lit(""))
    return F.when(comma, european).otherwise(plain).try_cast("double")


def products(found: DataFrame) -> DataFrame:
    """Products of JSON-LD: name, brand, sku, price, currency, availability, gtin, rating; offers may be a list."""
    get = lambda *paths: F.coalesce(*[F.get_json_object("json", p) for p in paths])
    own = found.where("type in ('product', 'productgroup')").select(
        "key",
        "url",
        "pos",
        get("$.name").alias("name"),
        get("$.brand.name", "$.brand").alias("brand"),
        get("$.sku", "$.mpn").alias("sku"),
        get("$.gtin13", "$.gtin", "$.gtin8", "$.gtin14", "$.ean").alias("gtin"),
        number(get("$.offers[0].price", "$.offers.price", "$.offers.lowPrice")).alias("price"),
        get("$.offers[0].priceCurrency", "$.offers.priceCurrency").alias("currency"),
        F.element_at(F.split(get("$.offers[0].availability", "$.offers.availability"), "/"), -1).alias("availability"),
        number(get("$.aggregateRating.ratingValue")).alias("rating"),
        number(get("$.aggregateRating.reviewCount", "$.aggregateRating.ratingCount")).alias("rating_count"),
        (F.col("type") == "productgroup").alias("is_group"),
        F.get_json_object("json", "$.offers").isNotNull().alias("has_offers"),
    )
    return own.withColumn("merchant_ready", F.col("name").isNotNull() & F.col("price").isNotNull() & F.col("currency").isNotNull() & F.col("availability").isNotNull())


def primary_product(found: DataFrame) -> DataFrame:
    """Per page: a group with offers before any with offers before the first."""
    rank = F.when(F.col("is_group") & F.col("has_offers"), 0).when(F.col("has_offers"), 1).when(~F.col("is_group"), 2).otherwise(3)
    return found.groupBy("key").agg(F.min_by(F.struct(*[c for c in found.columns if c != "key"]), F.struct(rank, "pos")).alias("p")).select("key", "p.*")


def fabricated_rating(found: DataFrame) -> DataFrame:
    """Ratings out of scale, without a count or with an absurd one."""
    own = products(found).where("rating is not null")
    return own.where("rating < 0 or rating > 5 or coalesce(rating_count, 0) = 0 or rating_count > 5000000").select("key", "name", "rating", "rating_count")


def schema_drift(found: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Products whose price isn't in the page's text in either notation."""
    own = products(found).where("price is not null").select("key", "name", "price")
    text = pages.select(F.col(key).cast("string").alias("key"), F.col("page.text").alias("text"))
    dot, comma = F.format_string("%.2f", "price"), F.replace(F.format_string("%.2f", "price"), F.lit("."), F.lit(","))
    whole = F.when(F.col("price") == F.floor("price"), F.col("price").cast("long").cast("string"))
    seen = F.contains("text", dot) | F.contains("text", comma) | F.coalesce(F.contains("text", whole), F.lit(False))
    return own.join(text, "key").where(~seen).select("key", "name", "price")


def geo(df: DataFrame) -> DataFrame:
    """Feeds, pagination, social profiles, contact, citability."""
    rel = lambda k: F.get(F.filter("page.rels", lambda x: F.array_contains(F.split(x["rel"], " "), k)), F.lit(0))["href"]
    links = F.col("page.links.target")
    social = [F.get(F.filter(links, _like(p)), F.lit(0)).alias(k) for k, p in SOCIAL.items()]
    hrefs = F.col("page.links.href")
    picked = lambda prefix: F.slice(F.array_sort(F.array_distinct(F.transform(F.filter(hrefs, lambda h: F.lower(h).startswith(prefix)), lambda h: F.regexp_extract(h, r"^[^:]*:([^?]*)", 1)))), 1, 5)
    asks = F.size(F.filter("page.headings", lambda h: h["text"].endswith("?")))
    return df.select(
        "*",
        F.struct(rel("next").alias("next"), rel("prev").alias("prev")).alias("pagination"),
        rel("amphtml").alias("amphtml"),
        F.transform(F.filter("page.rels", lambda x: x["type"].isin("application/rss+xml", "application/atom+xml")), lambda x: x["href"]).alias("rss_feeds"),
        F.struct(*social).alias("social_profiles"),
        picked("tel:").alias("phones"),
        picked("mailto:").alias("emails"),
        asks.alias("question_headings"),
        ((F.size(F.filter("page.jsonld", lambda d: d.rlike("FAQPage|HowTo|QAPage"))) > 0) | (asks >= 2) | ((F.col("page.tables") > 0) & (F.col("page.lists") > 0))).alias("citable"),
    )


def _like(pattern: str):
    return lambda t: F.lower(t).rlike(pattern)


def bot_rules(hosts: DataFrame) -> DataFrame:
    """host, bot, explicit, blocked: whether robots.txt names each robot, and shuts it out of the root."""
    own = hosts.select("host", F.explode(F.array(*[F.lit(b) for b in AI_BOTS])).alias("bot"), F.coalesce("robots_txt", F.lit("")).alias("r"))
    group = F.expr("regexp_extract(r, concat('(?is)user-agent:[ \\\\t]*', bot, '[ \\\\t]*\\\\R((?:(?!user-agent:).)*)'), 1)")
    return own.select("host", "bot", F.expr("r rlike concat('(?im)^user-agent:[ \\\\t]*', bot)").alias("explicit"), group.rlike(r"(?im)^disallow:[ \t]*/[ \t]*$").alias("blocked"))


def full(df: DataFrame) -> DataFrame:
    """The wide record: all row-level projections after one parse."""
    return geo(technical(images(links(content(headings(head(df)))))))
