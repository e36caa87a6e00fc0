"""Internal link structure per site: silos and their hubs, links from guides to shop pages, breadcrumbs, orphans, link plan.

Tables, keyed by U.link_key(): pages (url, title, h1, word_count, n_products, breadcrumbs, keywords: arrays of strings),
edges (src, dst, dst_raw, anchor, is_boiler), sitemap (url), ranks (node, pagerank). Sites are told apart by U.site(); every
score is a row per site, null where a site gives nothing to measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from .links import GENERIC_CONTEXT

#: Parts of a URL that tell service, shop and content pages, and silo names that mean the same.
PAGERANK_SERVICE = ("privacy", "voorwaarden", "cookie", "disclaimer", "financiering", "contact")
SERVICE = PAGERANK_SERVICE + (
    "algemene-voorwaarden", "verzendkosten", "verzending", "retour", "garantie", "verzekering", "over-ons", "over_ons",
    "klantenservice", "betaal", "levering", "bezorg", "herroeping", "afspraak", "reviews", "vacature", "sitemap",
    "inloggen", "account", "winkelwagen", "checkout", "bedankt", "login",
)
COMMERCIAL = (
    "/p/", "/product", "product-", "producten", "modellen", "model/", "/merk", "merken", "merk=", "categorie",
    "/category", "/c/", "collectie", "collection", "assortiment", "segment=", "/shop", "shop/", "webshop", "aanbod",
    "kopen/", "/pd/", "artikel/",
)
CONTENT = (
    "kennisbank", "blog", "/gids", "gidsen", "advies", "nieuws", "ratgeber", "guide", "artikel", "artikelen", "/tips",
    "inspiratie", "magazine", "achtergrond", "uitleg",
)
SYNONYMS = {
    "gidsen": "gids", "kennisbank": "gids", "blog": "gids", "advies": "gids", "artikelen": "gids", "artikel": "gids",
    "nieuws": "gids", "merken": "merk", "modellen": "model", "producten": "product", "p": "product",
    "categorieen": "categorie", "categorien": "categorie",
}
STOP = (
    "de", "het", "een", "en", "van", "voor", "met", "in", "op", "te", "uw", "u", "je", "is", "of", "om", "aan", "bij",
    "naar", "per", "als", "dat", "die", "wat", "waar", "hoe", "wie", "dit", "deze", "der", "den", "ten", "ter", "d",
    "the", "a", "to", "and", "of", "your", "you", "html", "www", "nl", "com",
)
COMMERCIAL_SILOS = ("model", "merk", "product", "categorie")
ROMAN = ("ii", "iii", "iv", "vi", "vii", "viii", "ix")
#: Weights of the scores, shared out among those that can be measured.
WEIGHTS = {"anchor": 0.22, "guide_link": 0.20, "silo": 0.18, "pagerank": 0.15, "breadcrumb": 0.15, "orphan": 0.10}
CONTENT_WORDS, PLAN_ROWS, ISSUE_ROWS = 700, 20, 12


def _holds(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def segments(url: Column) -> Column:
    return F.filter(F.split(U.path(url), "/"), lambda s: s != "")


def stem(segment: Column) -> Column:
    return F.regexp_replace(segment, r"\.(html?|php|aspx)$", "")


def silo(url: Column) -> Column:
    """The first of several path segments, or the only one up to a hyphen, by its canonical name; (home) for the root."""
    steps = segments(url)
    only = stem(F.get(steps, F.lit(0)))
    base = F.lower(F.when(F.size(steps) >= 2, F.get(steps, F.lit(0))).otherwise(F.when(only.contains("-"), F.split(only, "-")[0]).otherwise(only)))
    names = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.when(F.size(steps) == 0, "(home)").otherwise(F.coalesce(F.try_element_at(names, base), base))


def is_service(url: Column) -> Column:
    return _holds(F.lower(url), SERVICE)


def is_commercial(url: Column) -> Column:
    return _holds(F.lower(url), COMMERCIAL)


def is_content(url: Column, words: Column, products: Column) -> Column:
    long = (F.coalesce(words, F.lit(0)) >= CONTENT_WORDS) & (F.coalesce(products, F.lit(0)) == 0)
    return _holds(F.lower(url), CONTENT) | (long & ~is_service(url) & ~is_commercial(url))


def tokens(*texts: Column) -> Column:
    """Distinct words of three letters or more that aren't stop words."""
    every = F.split(F.lower(F.concat_ws(" ", *texts)), r"[^0-9a-zà-ÿ]+")
    return F.array_distinct(F.filter(every, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP)))


def looks_generic(text: Column) -> Column:
    """No text, one of the phrases that say nothing, or two characters at most, arrows and punctuation at the ends aside."""
    bare = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"[\s→›>»‹\-–—:.!?]+$", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[\s←«‹<\-–—]+", ""), r"\s+", " "))
    return bare.isin(*GENERIC_CONTEXT) | (F.length(bare) <= 2)


def humanized(slug: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(stem(F.coalesce(slug, F.lit(""))), "[-_]", " "), r"\s+", " "))


def titled(text: Column) -> Column:
    """A capital for every word; model codes and Roman numerals whole in capitals."""
    word = lambda w: F.when(w.rlike(r"\d") | F.lower(w).isin(*ROMAN), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), word), " ")


def clean_title(title: Column, brand: Column) -> Column:
    """The title's parts between bars, dots and dashes without the brand's name, unless nothing else is left."""
    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"\s*[|·•]\s*|\s+[–—-]\s+"), F.trim), lambda p: p != "")
    others = F.filter(parts, lambda p: (F.coalesce(brand, F.lit("")) == "") | (F.regexp_replace(F.lower(p), "[^a-z0-9]", "") != F.coalesce(brand, F.lit(""))))
    return F.array_join(F.when(F.size(others) > 0, others).otherwise(parts), " – ")


def brand_of(url: Column) -> Column:
    """The registered name before the last dot of the host, letters and digits only."""
    labels = F.split(U.site(url), r"\.")
    return F.regexp_replace(F.lower(F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(labels[0])), "[^a-z0-9]", "")


def _parameter(url: Column, name: str) -> Column:
    return F.regexp_replace(F.regexp_extract(U.query(url), rf"(?:^|&){name}=([^&]*)", 1), r"\+", " ")


def slug_anchors(url: Column) -> Column:
    """Anchor texts from the URL itself."""
    low, steps = F.lower(url), segments(url)
    last = F.when(F.size(steps) > 0, stem(F.element_at(steps, -1))).otherwise("")
    segment, brand, name = humanized(_parameter(url, "segment")), titled(humanized(_parameter(url, "merk"))), titled(humanized(last))
    of = lambda *parts: F.array(*parts)
    return (
        F.when((segment != "") & low.contains("segment="), of(F.concat(segment, F.lit(" modellen")), F.concat(F.lit("bekijk de "), segment, F.lit(" modellen"))))
        .when((brand != "") & low.contains("merk="), of(brand, F.concat(F.lit("alle "), brand, F.lit("-modellen"))))
        .when(_holds(low, ("/p/", "/product", "/pd/")), F.when(name != "", of(name, F.concat(F.lit("bekijk de "), name))))
        .when(last.isin("modellen", "model", "producten", "product", "assortiment", "aanbod"), of(F.lit("alle modellen"), F.lit("het volledige assortiment")))
        .when(last.isin("merken", "merk"), of(F.lit("alle merken"), F.lit("merkoverzicht")))
        .when((name != "") & ~humanized(last).isin("index", "home"), of(name))
    )


def suggested(url: Column, h1: Column, title: Column, keywords: Column, most: int = 3) -> Column:
    """Up to `most` distinct anchor texts for a target: its h1, cleaned title, keywords, then its URL; never a vague one."""
    clean = clean_title(title, brand_of(url))
    words = F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, 4)
    own = F.array(
        F.when(F.length(h1).between(3, 65), h1),
        F.when(F.length(clean).between(1, 70) & (F.lower(clean) != F.lower(F.coalesce(h1, F.lit("")))), clean),
        F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 3), " ")).otherwise(F.get(words, F.lit(0))),
    )
    every = F.concat(F.array_compact(own), F.when(F.size(F.array_compact(own)) < most, F.coalesce(slug_anchors(url), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    clean_up = F.filter(F.transform(every, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: (s != "") & ~looks_generic(s))
    first = F.filter(clean_up, lambda s, i: F.array_position(F.transform(clean_up, lambda t: F.lower(t)), F.lower(s)) == i + 1)
    return F.slice(first, 1, most)


def _pages(t: dict[str, DataFrame]) -> DataFrame:
    own = t["pages"]
    for name, kind in (("title", "string"), ("h1", "string"), ("word_count", "int"), ("n_products", "int"), ("breadcrumbs", "array<string>"), ("keywords", "array<string>")):
        if name not in own.columns:
            own = own.withColumn(name, F.lit(None).cast(kind))
    own = own.select(F.col("url"), "title", "h1", "word_count", "n_products", "breadcrumbs", "keywords", U.site(F.col("url")).alias("site"), U.link_key(F.col("url")).alias("node"))
    return own.withColumn("content", is_content(F.col("url"), F.col("word_count"), F.col("n_products"))).withColumn("silo", silo(F.col("node")))


def _edges(t: dict[str, DataFrame]) -> DataFrame:
    own = t["edges"]
    own = own.select("src", "dst", (F.col("dst_raw") if "dst_raw" in own.columns else F.col("dst")).alias("dst_raw"), "anchor", F.coalesce("is_boiler", F.lit(False)).alias("is_boiler"))
    return own.withColumn("site", U.site(F.col("src"))).withColumn("dst_silo", silo(F.col("dst")))


def nodes(t: dict[str, DataFrame]) -> DataFrame:
    """site, node, silo of everything crawled, linked inside its site, or in its sitemap, once each."""
    edges = _edges(t)
    linked = edges.where(U.site(F.col("dst")) == F.col("site")).select("site", F.col("dst").alias("node"))
    every = _pages(t).select("site", "node").unionByName(linked)
    if "sitemap" in t:
        every = every.unionByName(t["sitemap"].select(U.site(F.col("url")).alias("site"), U.link_key(F.col("url")).alias("node")))
    return every.distinct().withColumn("silo", silo(F.col("node")))


def silos(members: DataFrame) -> DataFrame:
    """Per site and silo: members, whether it sells, and its hub, the page whose only path segment is the silo's name or a synonym."""
    steps = segments(F.col("node"))
    name = F.lower(stem(F.get(steps, F.lit(0))))
    names = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    landing = (F.size(steps) == 1) & ((name == F.col("silo")) | (F.try_element_at(names, name) == F.col("silo")))
    order = F.struct(F.col("node").contains("?"), F.length(U.path(F.col("node"))), F.col("node"))
    sells = F.col("silo").isin(*COMMERCIAL_SILOS) | is_commercial(F.col("node"))
    return members.groupBy("site", "silo").agg(
        F.count("*").alias("members"), F.bool_or(sells).alias("commercial"), F.min_by(F.when(landing, F.col("node")), F.when(landing, order)).alias("hub")
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1)


def _count(test: Column) -> Column:
    return F.sum(F.coalesce(test, F.lit(False)).cast("int"))


def anchor_scores(t: dict[str, DataFrame]) -> DataFrame:
    own = _edges(t).where("not is_boiler and anchor is not null")
    return own.groupBy("site").agg(F.round(100.0 * (1 - F.avg(looks_generic(F.col("anchor")).cast("double"))), 1).alias("anchor"))


def silo_scores(t: dict[str, DataFrame]) -> DataFrame:
    """Mean of two shares: pages that link back to their silo's hub, and content and home pages that link into a silo that sells."""
    pages, edges, groups = _pages(t), _edges(t), silos(nodes(t))
    hubs = groups.where("hub is not null and members >= 2 and silo <> '(home)'").select("site", "silo", "hub")
    need = pages.join(hubs, ["site", "silo"]).where("hub <> node").select("site", "node", "hub")
    back = need.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("hub")).distinct().withColumn("linked", F.lit(1)), ["node", "hub"], "left")
    one = back.groupBy("site").agg((F.count("linked") / F.count("*")).alias("back"))
    selling = groups.where("commercial").select("site", F.col("silo").alias("dst_silo"))
    into = edges.where("not is_boiler").join(selling, ["site", "dst_silo"], "left_semi").select("site", F.col("src").alias("node")).distinct().withColumn("into", F.lit(1))
    two = pages.where("content or silo = '(home)'").select("site", "node").join(into, ["site", "node"], "left").join(selling.select("site").distinct(), "site", "left_semi")
    two = two.groupBy("site").agg((F.count("into") / F.count("*")).alias("reach"))
    both = one.join(two, "site", "full")
    parts = F.coalesce("back", F.lit(0.0)) + F.coalesce("reach", F.lit(0.0))
    return both.select("site", F.round(100.0 * parts / (F.col("back").isNotNull().cast("int") + F.col("reach").isNotNull().cast("int")), 1).alias("silo"))


def guide_scores(t: dict[str, DataFrame]) -> DataFrame:
    """Share of content pages with a link in their text to a shop page."""
    sells = _edges(t).where(~F.col("is_boiler") & is_commercial(F.col("dst_raw"))).select("site", F.col("src").alias("node")).distinct().withColumn("ok", F.lit(1))
    own = _pages(t).where("content").join(sells, ["site", "node"], "left")
    return own.groupBy("site").agg(_percent(F.count("ok"), F.count("*")).alias("guide_link"))


def breadcrumb_scores(t: dict[str, DataFrame]) -> DataFrame:
    """Share of pages two path segments deep or more that have breadcrumbs."""
    deep = _pages(t).where(F.size(segments(F.col("url"))) >= 2)
    has = F.size(F.filter(F.coalesce("breadcrumbs", F.array().cast("array<string>")), lambda x: F.trim(x) != "")) >= 1
    return deep.groupBy("site").agg(_percent(_count(has), F.count("*")).alias("breadcrumb"))


def breadcrumb_gaps(t: dict[str, DataFrame]) -> DataFrame:
    """Per site and first path segment: deep pages without breadcrumbs."""
    has = F.size(F.filter(F.coalesce("breadcrumbs", F.array().cast("array<string>")), lambda x: F.trim(x) != "")) >= 1
    own = _pages(t).where((F.size(segments(F.col("url"))) >= 2) & ~has)
    return own.groupBy("site", F.concat(F.lit("/"), F.get(segments(F.col("url")), F.lit(0))).alias("prefix")).agg(F.count("*").alias("pages"), F.min("url").alias("first_url"))


def orphan_scores(t: dict[str, DataFrame]) -> DataFrame:
    """100 less the share of crawled pages that nothing links to, and half the share of such sitemap entries times the crawl's share of the sitemap."""
    linked = _edges(t).where("src <> dst").select(F.col("dst").alias("node")).distinct().withColumn("linked", F.lit(1))
    crawled = _pages(t).select("site", "node", (F.size(segments(F.col("node"))) == 0).alias("home")).distinct().join(linked, "node", "left")
    one = crawled.groupBy("site").agg(F.count("*").alias("crawled"), _count(F.col("linked").isNull() & ~F.col("home")).alias("orphan_crawled"))
    if "sitemap" in t:
        listed = t["sitemap"].select(U.site(F.col("url")).alias("site"), U.link_key(F.col("url")).alias("node")).distinct().join(linked, "node", "left")
        two = listed.groupBy("site").agg(F.count("*").alias("listed"), _count(F.col("linked").isNull()).alias("orphan_sitemap"))
        one = one.join(two, "site", "left")
    else:
        one = one.withColumn("listed", F.lit(0)).withColumn("orphan_sitemap", F.lit(0))
    ratio = F.when(F.coalesce("listed", F.lit(0)) > 0, F.col("crawled") / F.col("listed")).otherwise(1.0)
    lost = 100.0 * F.col("orphan_crawled") / F.col("crawled") + F.when(F.coalesce("listed", F.lit(0)) > 0, 50.0 * F.col("orphan_sitemap") / F.col("listed") * ratio).otherwise(0.0)
    return one.withColumn("crawl_ratio", F.round(ratio, 3)).withColumn("largely_crawl_artifact", (F.coalesce("listed", F.lit(0)) > 0) & (ratio < 0.5)).withColumn(
        "orphan", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - lost)), 1)
    )


def ranked(ranks: DataFrame) -> DataFrame:
    """site, node, pagerank and its place within the site, from 1; equal ranks by node."""
    own = ranks.withColumn("site", U.site(F.col("node")))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("pagerank"), "node")))


def pagerank_scores(t: dict[str, DataFrame]) -> DataFrame:
    """100, but for sites of three pages or more whose upper half holds service pages and no shop page: 70 less 0.4 times those pages' percentage of all rank, 20 at least."""
    own = ranked(t["ranks"])
    size = own.groupBy("site").agg(F.count("*").alias("n"), F.sum("pagerank").alias("whole")).where("n >= 3")
    top = own.join(size, "site").where("place <= (n + 1) div 2")
    service = _holds(F.lower("node"), PAGERANK_SERVICE)
    by = top.groupBy("site").agg(F.sum(F.when(service, F.col("pagerank") / F.col("whole")).otherwise(0.0)).alias("share"), F.bool_or(service).alias("service"), F.bool_or(is_commercial(F.col("node"))).alias("shop"))
    score = F.when(F.col("service") & ~F.col("shop"), F.greatest(F.lit(20.0), 70.0 - 40.0 * F.least(F.lit(1.0), F.col("share")))).otherwise(100.0)
    return by.select("site", F.round(score, 1).alias("pagerank"))


def scores(t: dict[str, DataFrame]) -> DataFrame:
    """Per site the six scores and their weighted mean over those that can be measured."""
    out = _pages(t).select("site").distinct()
    parts = [anchor_scores(t), guide_scores(t), silo_scores(t), breadcrumb_scores(t), orphan_scores(t).select("site", "orphan")]
    if "ranks" in t:
        parts.append(pagerank_scores(t))
    for p in parts:
        out = out.join(p, "site", "left")
    if "ranks" not in t:
        out = out.withColumn("pagerank", F.lit(None).cast("double"))
    total = sum((F.when(F.col(k).isNotNull(), F.col(k) * w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("score", F.when(weight > 0, F.round(total / weight, 1)))


def inbound(t: dict[str, DataFrame]) -> DataFrame:
    """node, inbound: the larger of distinct linking pages and of what the link graph counts, where there is one (graph: node, inbound)."""
    dom = _edges(t).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n"))
    if "graph" not in t:
        return dom.select("node", F.col("n").alias("inbound"))
    both = dom.join(t["graph"].select("node", F.col("inbound").alias("g")), "node", "full")
    return both.select("node", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("g", F.lit(0))).alias("inbound"))


def guide_targets(t: dict[str, DataFrame], most: int = 3) -> DataFrame:
    """For each content page without a link to a shop page, the shop pages of its site that share most words with it; the first two by path if none does."""
    pages, edges = _pages(t), _edges(t)
    done = edges.where(~F.col("is_boiler") & is_commercial(F.col("dst_raw"))).select(F.col("src").alias("node"))
    title = tokens(F.col("title"), F.col("h1"), F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 8), " "))
    guides = pages.where("content").join(done, "node", "left_anti").select("site", F.col("node").alias("guide"), title.alias("words"))
    shops = nodes(t).where(is_commercial(F.col("node"))).join(pages.select("node", "title", "h1"), "node", "left")
    named = F.when(F.col("title").isNotNull() | F.col("h1").isNotNull(), tokens(F.col("title"), F.col("h1"))).otherwise(
        tokens(humanized(F.element_at(F.split(U.path(F.col("node")), "/"), -1)), _parameter(F.col("node"), "segment"), _parameter(F.col("node"), "merk"))
    )
    shops = shops.select("site", F.col("node").alias("shop"), named.alias("shop_words"))
    # Only pairs with a common word meet; pages without any take the site's first two shop pages.
    left, right = guides.select("site", "guide", F.explode("words").alias("w")), shops.select("site", "shop", F.explode("shop_words").alias("w"))
    found = left.join(right, ["site", "w"]).groupBy("site", "guide", "shop").agg(F.count("*").alias("overlap"))
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("guide").orderBy(F.desc("overlap"), U.path(F.col("shop")), "shop"))).where(F.col("place") <= most)
    few = shops.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(U.path(F.col("shop")), "shop"))).where("place <= 2").select("site", "shop", "place")
    rest = guides.select("site", "guide").join(found.select("guide").distinct(), "guide", "left_anti").join(few, "site")
    return best.select("site", "guide", "shop", "overlap", "place").unionByName(rest.select("site", "guide", "shop", F.lit(0).cast("long").alias("overlap"), "place"))


def vague_targets(t: dict[str, DataFrame]) -> DataFrame:
    """Important targets of vague anchors in the text: shop pages, pages with two inbound links or more, and pages of the link graph."""
    vague = _edges(t).where(~F.col("is_boiler") & F.col("anchor").isNotNull() & looks_generic(F.col("anchor")))
    by = vague.groupBy("site", F.col("dst").alias("node")).agg(F.count("*").alias("links"), F.min("dst_raw").alias("raw")).join(inbound(t), "node", "left")
    known = t["graph"].select("node").distinct().withColumn("known", F.lit(True)) if "graph" in t else None
    by = by.join(known, "node", "left") if known is not None else by.withColumn("known", F.lit(None).cast("boolean"))
    own = by.where(is_commercial(F.col("raw")) | (F.col("inbound") >= 2) | F.coalesce("known", F.lit(False)))
    return own.withColumn("severity", F.when(is_commercial(F.col("raw")), "High").otherwise("Medium")).select("site", "node", "links", "inbound", "severity")


def link_plan(t: dict[str, DataFrame], most: int = PLAN_ROWS) -> DataFrame:
    """The `most` targets of a site that need links most: importance, inbound links, suggested anchors, and up to three pages to link from."""
    pages = _pages(t)
    generic = vague_targets(t).select("node").distinct().withColumn("generic", F.lit(1))
    known = (t["graph"] if "graph" in t else pages).select("node").distinct().withColumn("known", F.lit(1))
    own = nodes(t).join(known, "node", "left").join(generic, "node", "left").join(inbound(t), "node", "left")
    own = own.where(is_commercial(F.col("node")) | F.col("known").isNotNull() | F.col("generic").isNotNull()).withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    base = F.when(is_commercial(F.col("node")), 2.0).when(F.col("known").isNotNull(), 1.0).otherwise(0.0)
    value = base + F.coalesce("generic", F.lit(0)) + F.when(F.col("inbound") >= 1, 0.6).otherwise(0.0) + F.greatest(F.lit(0), 2 - F.col("inbound")) * 0.2
    own = own.withColumn("importance", F.round(value, 3))
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("importance"), "inbound", U.path(F.col("node")), "node"))
    top = own.withColumn("place", place).where(F.col("place") <= most)
    facts = pages.dropDuplicates(["node"]).select("node", "title", "h1", "keywords")
    top = top.join(facts, "node", "left").select("site", "place", "node", "importance", "inbound", suggested(F.col("node"), F.col("h1"), F.col("title"), F.col("keywords")).alias("anchors"), "title")
    words = tokens(F.col("title"), humanized(F.element_at(F.split(U.path(F.col("node")), "/"), -1)), _parameter(F.col("node"), "segment"), _parameter(F.col("node"), "merk"))
    wanted = top.select("site", "node", F.explode(words).alias("w"))
    source = pages.where("content or silo = '(home)'").select("site", F.col("node").alias("source"), F.explode(tokens(F.col("title"), F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 6), " "))).alias("w"))
    done = _edges(t).select(F.col("src").alias("source"), F.col("dst").alias("node")).distinct()
    from_ = wanted.join(source, ["site", "w"]).where("source <> node").select("node", "source").distinct().join(done, ["source", "node"], "left_anti")
    from_ = from_.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("source"))).where("n <= 3").groupBy("node").agg(F.array_sort(F.collect_list("source")).alias("link_from"))
    return top.drop("title").join(from_, "node", "left").withColumn("link_from", F.coalesce("link_from", F.array().cast("array<string>")))
