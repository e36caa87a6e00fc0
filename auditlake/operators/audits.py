"""Site audits over render tables, link checks and scored pages. Each gives one row per site (U.site() of the url), or the groups behind it.

An audit that can't measure anything has a null score: what isn't measurable leaves numerator and denominator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import url as U
from . import silos
from .graph import cut


@dataclass(frozen=True)
class Audit:
    name: str
    order: int
    run: Callable[[dict[str, DataFrame]], DataFrame]


REGISTRY: dict[str, Audit] = {}


def audit(name: str, order: int):
    def add(f):
        REGISTRY[name] = Audit(name, order, f)
        return f

    return add


def run_all(tables: dict[str, DataFrame], spark) -> DataFrame:
    """site, name, score, error of every audit in order; one that fails gives its error, without a site, not an end."""
    out = None
    for a in sorted(REGISTRY.values(), key=lambda a: (a.order, a.name)):
        try:
            rows = cut(a.run(tables).select("site", F.lit(a.name).alias("name"), F.col("score").cast("double").alias("score"), F.lit(None).cast("string").alias("error")))
        except Exception as e:  # an audit's failure is its result
            rows = spark.createDataFrame([(None, a.name, None, f"{type(e).__name__}: {str(e)[:200]}")], "site string, name string, score double, error string")
        out = rows if out is None else out.unionByName(rows)
    return out


def by_site(df: DataFrame, url: str = "url") -> DataFrame:
    return df if "site" in df.columns else df.withColumn("site", U.site(F.col(url)))


def weighted(*parts: tuple[Column, float]) -> Column:
    """Weighted mean of the values that aren't null."""
    total = sum((F.when(v.isNotNull(), v * w).otherwise(F.lit(0.0)) for v, w in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


@audit("render_coverage", 10)
def render_coverage(t: dict[str, DataFrame]) -> DataFrame:
    pages, shown = t["pages"].select("url").distinct(), t["render_texts"].select("url").distinct()
    own = by_site(pages.join(shown.withColumn("seen", F.lit(1)), "url", "left"))
    return own.groupBy("site").agg(F.count("*").alias("pages"), F.count("seen").alias("rendered"), F.round(100 * F.count("seen") / F.count("*"), 1).alias("score"))


@audit("health", 15)
def health(t: dict[str, DataFrame]) -> DataFrame:
    """100 less penalties for broken and redirected sitemap urls, canonical mismatches, unminified own assets, invalid schemas and H1 and word-count gaps.

    assets belong to the site of the page that holds them; schemas are the rows of records.validated().
    """
    checks, pages, sitemap = t["url_checks"], by_site(t["pages"]), by_site(t["sitemap"])
    probed = sitemap.join(checks.select("url", "status"), "url", "left")
    one = probed.groupBy("site").agg(F.sum((F.col("status") >= 400).cast("int")).alias("broken"), F.sum(F.col("status").between(300, 399).cast("int")).alias("redirects"))
    key = U.health_key(F.col("url")).alias("k")
    wrong = sitemap.select("site", key).join(pages.select(key, "canonical"), "k").where((F.coalesce("canonical", F.lit("")) != "") & (U.health_key(F.col("canonical")) != F.col("k")))
    two = wrong.groupBy("site").agg(F.count("*").alias("mismatches"))
    percent = lambda test: 100 * F.sum(test.cast("int")) / F.greatest(F.lit(1), F.count("*"))
    three = pages.groupBy("site").agg(percent(F.col("h1_count") == 0).alias("no_h1"), percent(F.col("h1_count") > 1).alias("multi_h1"), percent(F.col("word_count") < 300).alias("thin"))
    assets = by_site(t["assets"], "page" if "page" in t["assets"].columns else "url")
    four = assets.groupBy("site").agg(F.sum((~minified(F.col("text"), F.col("url")) & F.col("first_party")).cast("int")).alias("unminified"))
    bad = by_site(t["schemas"].where("status = 'invalid'")).select("site", "type", "url").distinct()
    five = bad.groupBy("site").agg(F.least(F.lit(20), F.count("*")).alias("schemas"))
    own = three
    for part in (one, two, four, five):
        own = own.join(part, "site", "left")
    own = own.na.fill(0)
    penalty = F.col("broken") * 4 + F.col("redirects") * 2 + F.col("mismatches") * 2 + F.col("unminified") * 3 + F.col("schemas") + F.col("no_h1") * 0.3 + F.col("multi_h1") * 0.15 + F.col("thin") * 0.2
    return own.withColumn("score", F.greatest(F.lit(0.0), F.round(100 - penalty).cast("double")))


def minified(text: Column, url: Column) -> Column:
    name = url.rlike(r"(?i)\.min\.(js|css)([?#]|$)|[-.][0-9a-f]{8,}\.(js|css)")
    lines = F.greatest(F.lit(1), F.size(F.split(F.regexp_replace(text, r"\n$", ""), "\n")))
    mean = F.length(text) / lines
    blank = (F.length(text) - F.length(F.regexp_replace(text, r"[ \t\n]", ""))) / F.greatest(F.lit(1), F.length(text))
    return name | (F.length(text) < 2048) | (mean >= 400) | ((mean >= 160) & (blank < 0.14))


def text_contrast(texts: DataFrame) -> DataFrame:
    """Rendered texts with colours, contrast and norm; those over photos or of unknown colour have no ratio."""
    own = texts.withColumn("back", C.parsed(F.col("bg")))
    own = own.withColumn("front", C.over(C.parsed(F.col("color")), F.col("back")))
    ratio = F.when(~F.coalesce("bgImage", F.lit(False)), C.contrast(F.col("front"), F.col("back")))
    own = own.withColumn("ratio", F.round(ratio, 2)).withColumn("norm", C.required(F.col("fontSize"), F.col("fontWeight")))
    return own.withColumn("pattern", pattern(F.col("selector")))


def pattern(selector: Column) -> Column:
    """The last two steps of a selector without positions and state classes."""
    steps = F.slice(F.split(F.coalesce(selector, F.lit("")), r"\s*>\s*|\s+"), -2, 2)
    whole = F.when(F.size(F.split(F.coalesce(selector, F.lit("")), r"\s*>\s*|\s+")) < 2, F.array(F.coalesce(selector, F.lit("")))).otherwise(steps)
    clean = F.transform(whole, lambda s: F.regexp_replace(s, r":nth-[a-z-]+\([^)]*\)|\.(is-)?(active|hover|open|selected|current|focus)\b", ""))
    return F.array_join(clean, " > ")


def contrast_groups(texts: DataFrame) -> DataFrame:
    """Failing texts by colours and pattern: elements, pages, worst ratio, an example, and a colour that would pass."""
    own = text_contrast(texts).where("ratio < norm")
    by = own.groupBy(C.hexed(F.col("front")).alias("fg"), C.hexed(F.col("back")).alias("bg_hex"), "pattern").agg(
        F.count("*").alias("elements"),
        F.countDistinct("url").alias("pages"),
        F.min("ratio").alias("worst"),
        F.min_by(F.struct("url", "text", "front", "back", "norm"), F.struct("ratio", "url", "selector")).alias("example"),
    )
    fix = C.accessible(F.col("example.front"), F.col("example.back"), F.col("example.norm"))
    return by.select("fg", "bg_hex", "pattern", "elements", "pages", "worst", F.col("example.url").alias("url"), F.col("example.text").alias("text"), fix.alias("passing"))


def photo_groups(texts: DataFrame) -> DataFrame:
    """Texts over photos are judged by their group's median contrast (column photo_ratio), all members alike."""
    own = texts.where("bgImage").withColumn("pattern", pattern(F.col("selector"))).withColumn("norm", C.required(F.col("fontSize"), F.col("fontWeight")))
    by = own.groupBy("pattern").agg(F.percentile("photo_ratio", 0.5).alias("median"), F.max("norm").alias("norm"), F.count("*").alias("elements"))
    return by.withColumn("passes", F.col("median") >= F.col("norm"))


def photo_verdicts(texts: DataFrame) -> DataFrame:
    """Every text over a photo with its group's verdict."""
    own = texts.where("bgImage").withColumn("pattern", pattern(F.col("selector")))
    return own.join(photo_groups(texts).select("pattern", "median", "passes"), "pattern", "left")


def contrast_issues(texts: DataFrame, fails: DataFrame, most: int = 60) -> DataFrame:
    """The `most` contrast groups by the score of the page that shows them (fails: url, score), then by pages and elements."""
    rows = contrast_groups(texts).join(fails.select("url", F.col("score").alias("page_score")), "url", "left")
    return rows.orderBy(F.asc_nulls_last("page_score"), F.desc("pages"), F.desc("elements"), "fg", "bg_hex", "pattern").limit(most)


@audit("contrast", 70)
def contrast(t: dict[str, DataFrame]) -> DataFrame:
    """0.6 x mobile + 0.4 x desktop percentage of texts that reach their norm."""
    own = by_site(text_contrast(t["render_texts"]).where("ratio is not null"))
    share = lambda v: 100 * F.avg(F.when(F.col("viewport") == v, (F.col("ratio") >= F.col("norm")).cast("int")))
    both = own.groupBy("site").agg(share("mobile").alias("mobile"), share("desktop").alias("desktop"))
    return both.select("site", F.round(weighted((F.col("mobile"), 0.6), (F.col("desktop"), 0.4)), 1).alias("score"), "mobile", "desktop")


def small_fonts(texts: DataFrame) -> DataFrame:
    """Texts under 11 px, and mobile body texts from 11 to under 16 px, by pattern and size."""
    size = F.col("fontSize")
    kind = F.when(size < 11, "micro").when((F.col("viewport") == "mobile") & (size < 16) & (F.length("text") > 40), "body")
    own = texts.withColumn("kind", kind).where("kind is not null").withColumn("pattern", pattern(F.col("selector")))
    return own.groupBy("kind", "pattern", F.round("fontSize", 1).alias("size")).agg(F.count("*").alias("elements"), F.countDistinct("url").alias("pages"))


#: Words in a source, class, alt or ancestor that decide what an image is.
HERO = ("/lifestyle/", "hero-", "/hero", "sfeer", "/banner", "banner", "slider", "swiper", "carousel")
EXCLUDE = (
    "logo", "brand", "icon", "ico-", "sprite", "favicon", "payment", "/pay/", "pay-", "ideal", "klarna", "visa", "master",
    "maestro", "bancontact", "amex", "paypal", "keurmerk", "trust", "thuiswinkel", "webwinkelkeur", "flag", "avatar",
    "rating", "review", "star-",
)
PRODUCT = ("product", "realproduct", "card", "item", "thumb", "gallery", "pdp", "grid", "shop", "catalog", "listing", "artikel")


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def image_kind(images: DataFrame) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "src", "classes", "alt", "ancestors"))
    path = F.lower(U.path(F.col("src")))
    width = F.col("displayW")
    kind = (
        F.when((width > 0) & (width < 80), "other").when(_any(text, HERO), "hero").when(_any(text, EXCLUDE), "other")
        .when(_any(path, ("product", "realproduct", "/shop/", "/artikel")) | _any(text, PRODUCT), "product")
        .when(F.contains(F.lower(U.path(F.col("url"))), F.lit("product")) & (width >= 200), "product").otherwise("other")
    )
    return images.withColumn("kind", kind)


@audit("images", 30)
def images(t: dict[str, DataFrame]) -> DataFrame:
    """Fill, white on dark, resolution, format and weight, alt and duplicates, over product photos."""
    own = by_site(image_kind(t["render_images"]).where("kind = 'product'"))
    own = own.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("fill_pct", "double"), ("file_kb", "double"), ("white_on_dark", "boolean"), ("duplicate", "boolean")) if c not in own.columns])
    scale = F.col("naturalWidth") / F.nullif("displayW", F.lit(0))
    heavy = F.col("file_kb") > F.when(F.col("displayW") >= 200, 300).otherwise(150)
    share = lambda c: F.avg(c.cast("double"))
    png = F.lower("src").rlike(r"\.png(\?|#|$)")
    alt = F.length(F.trim(F.coalesce("alt", F.lit("")))) < 5
    by = own.groupBy("site").agg(
        F.count("*").alias("photos"),
        (100 * F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("fill_pct") - 45) / 35)))).alias("fill"),
        (100 * (1 - share(F.col("white_on_dark")))).alias("background"),
        (100 * F.greatest(F.lit(0.0), 1 - share(F.coalesce(scale < 0.9, F.lit(False))) - 0.4 * share(F.coalesce(scale > 3, F.lit(False))))).alias("resolution"),
        (100 * F.greatest(F.lit(0.0), 1 - 0.6 * share(png) - share(F.coalesce(heavy, F.lit(False))))).alias("weight"),
        (100 * (1 - share(alt))).alias("alt_text"),
        (100 * F.greatest(F.lit(0.0), 1 - share(F.coalesce("duplicate", F.lit(False))))).alias("unique"),
    )
    parts = (("fill", 0.45), ("background", 0.18), ("resolution", 0.12), ("weight", 0.12), ("alt_text", 0.10), ("unique", 0.04))
    return by.withColumn("score", F.when(F.col("photos") > 0, F.round(weighted(*[(F.col(c), w) for c, w in parts]), 1)))


def image_duplicates(hashes: DataFrame, most: int = 6) -> DataFrame:
    """name, leader: the first earlier image within `most` differing bits of the 64-bit hash that is itself a leader.

    Hashes are cut into most + 1 bands: two within `most` bits agree on one, so that only images that share a band meet.
    """
    bands = most + 1
    width = -(-64 // bands)
    band = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"shiftrightunsigned(ahash, {k * width}) & {(1 << width) - 1}L").alias("v")) for k in range(bands)])).alias("b")
    own = hashes.select("name", "ahash", band).select("name", "ahash", "b.*")
    other = own.select(F.col("name").alias("leader"), F.col("ahash").alias("h"), "k", "v")
    near = own.join(other, ["k", "v"]).where(f"leader < name and bit_count(ahash ^ h) <= {most}").select("name", "leader").distinct()
    # Greedy: an image follows its first earlier match that follows none. Each round settles the followers of new leaders,
    # and as leaders the images whose earlier matches all follow; the first unsettled image is always among them.
    near = cut(near)
    pairs, unsettled = near, near.select("name").distinct()
    new = leaders = hashes.select("name").join(unsettled, "name", "left_anti").distinct()
    while not unsettled.isEmpty():
        gone = cut(pairs.join(new.withColumnRenamed("name", "leader"), "leader", "left_semi").select("name").distinct())
        pairs = cut(pairs.join(gone, "name", "left_anti").join(gone.withColumnRenamed("name", "leader"), "leader", "left_anti"))
        unsettled = unsettled.join(gone, "name", "left_anti")
        new = cut(unsettled.join(pairs, "name", "left_anti"))
        unsettled = cut(unsettled.join(new, "name", "left_anti"))
        leaders = leaders.unionByName(new)
    return near.join(leaders.withColumnRenamed("name", "leader"), "leader", "left_semi").groupBy("name").agg(F.min("leader").alias("leader"))


#: Class prefixes of icon sets.
ICON_SETS = (
    ("fa fas far fab fal fad fa-solid fa-regular fa-brands fa-light", "FontAwesome"), ("bi", "Bootstrap Icons"),
    ("material-icons material-symbols material-symbols-outlined mat-icon mdi", "Material Icons"), ("lucide", "Lucide"),
    ("feather", "Feather"), ("ion ionicon ion-icon", "Ionicons"), ("ti tabler tabler-icon", "Tabler"), ("bx bxs bxl", "Boxicons"),
    ("gg", "css.gg"), ("glyphicon", "Glyphicons"), ("dashicons", "Dashicons"), ("icon", "icon-font"),
)


def icon_families(icons: DataFrame) -> DataFrame:
    """Icons by family: set by class, else grid of the view box; significant from max(2, 5 %), for fonts, or from 3 images."""
    tokens = F.split(F.lower(F.coalesce("classes", F.lit(""))), " ")
    named = F.coalesce(*[F.when(F.exists(tokens, _starts(prefixes.split())), F.lit(name)) for prefixes, name in ICON_SETS])
    grid = F.concat(F.lit("grid "), F.regexp_extract("viewBox", r"^\S+\s+\S+\s+([0-9.]+)", 1))
    own = by_site(icons).where("kind <> 'emoji'").withColumn("family", F.coalesce(named, F.when(F.col("viewBox").isNotNull(), grid), F.col("fontFamily"), F.col("kind")))
    by = own.groupBy("site", "family").agg(F.count("*").alias("n"), F.countDistinct("url").alias("pages"), F.max((F.col("kind") == "iconfont").cast("int")).alias("font"), F.max((F.col("kind") == "img").cast("int")).alias("image"))
    total = by.groupBy("site").agg(F.sum("n").alias("total"))
    least = F.greatest(F.lit(2), F.round(0.05 * F.col("total")))
    return by.join(total, "site").withColumn("significant", (F.col("n") >= least) | (F.col("font") == 1) | ((F.col("image") == 1) & (F.col("n") >= 3))).drop("total")


def icon_styles(icons: DataFrame) -> DataFrame:
    """Per site the fills and stroke widths of drawn icons: uses and pages."""
    own = by_site(icons).where("kind = 'svg'")
    sort = F.explode(F.array(F.struct(F.lit("fill").alias("style"), F.lower("fill").alias("value")), F.struct(F.lit("stroke").alias("style"), F.lower("strokeWidth").alias("value")))).alias("s")
    return own.select("site", "url", sort).select("site", "url", "s.*").where("value is not null").groupBy("site", "style", "value").agg(F.count("*").alias("uses"), F.countDistinct("url").alias("pages"))


#: Parts of a page in which icons are compared with each other, the first that an ancestor names.
CONTEXTS = ("nav", "header", "footer", "button", "card", "list", "table", "form")


def icon_context(ancestors: Column) -> Column:
    text = F.lower(F.coalesce(ancestors, F.lit("")))
    return F.coalesce(*[F.when(text.rlike(rf"(^|[^a-z]){c}"), F.lit(c)) for c in CONTEXTS], F.lit("other"))


def icon_sizes(icons: DataFrame) -> DataFrame:
    """Contexts of a site whose icons (three or more) differ in height by 1.8 times and 10 pixels at least."""
    own = by_site(icons).where("h > 0").withColumn("context", icon_context(F.col("ancestors")))
    by = own.groupBy("site", "viewport", "context").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    return by.where("n >= 3 and high >= 1.8 * low and high - low >= 10")


def _starts(prefixes):
    return lambda t: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: (t == p) | F.startswith(t, F.concat(p, F.lit("-"))))


@audit("icons", 40)
def icons(t: dict[str, DataFrame]) -> DataFrame:
    """100 less penalties for emoji used as icons, for several families, and for icon fonts."""
    families = icon_families(t["render_icons"]).where("significant")
    emoji = by_site(t["render_icons"]).where("kind = 'emoji'").select("site", "char", "selector", "shortText").distinct()
    one = families.groupBy("site").agg(F.count("*").alias("families"), F.coalesce(F.max("font"), F.lit(0)).alias("font"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    two = emoji.groupBy("site").agg(F.coalesce(F.sum(F.col("shortText").cast("int")), F.lit(0)).alias("hard"), F.coalesce(F.sum((~F.col("shortText")).cast("int")), F.lit(0)).alias("soft"))
    own = one.join(two, "site", "full").na.fill(0)
    lost = F.least(F.lit(48), F.col("hard") * 8) + F.least(F.lit(20), F.col("soft") * 4) + F.when(F.col("families") >= 2, F.least(F.lit(30), (F.col("families") - 1) * 12)).otherwise(0) + F.col("font") * 6
    return own.withColumn("score", F.when((F.col("n") > 0) | (F.col("hard") > 0), F.greatest(F.lit(0.0), (F.lit(100) - lost).cast("double"))))


@audit("links", 50)
def links(t: dict[str, DataFrame]) -> DataFrame:
    """The six scores of internal linking and their weighted mean, from pages, edges, sitemap and ranks; see silos."""
    return silos.scores(t)


#: Weights of the conversion checks.
CONVERSION = {"cta_fold": 3.0, "one_message": 1.5, "trust": 2.0, "checkout": 3.0, "price": 3.0, "urgency": 1.0, "form_length": 0.5}
#: Word lists of this library for the signals below, in Dutch and English.
_CTA = r"(?i)winkelwagen|in\s?mand|bestel|(?<![a-z])koop|kopen|afreken|kassa|offerte|aanvra|proefrit|reserve|boek|toevoeg|bekijk|(?<![a-z])shop(?![a-z])|contact|abonneer|(^|[\s_-])(btn|button|cta|buy|order)($|[\s_-])"
_TRUST = (r"(?i)review|beoordel|sterren|★|waardering|trustpilot|kiyoh", r"(?i)retour|geld[-\s]?terug|garantie|bedenktijd|omruil", r"(?i)ideal|klarna|bancontact|paypal|riverty|afterpay|veilig\s+betalen|creditcard|(?<![a-z])visa(?![a-z])")
_URGENT = r"(?i)op\s?=\s?op|laatste\s+kans|bijna\s+uitverkocht|wees\s+er\s+snel\s+bij|mis\s+het\s+niet|nu\s+of\s+nooit|verloopt\s+(over|binnen|vandaag)|nog\s+(maar\s+)?\d+\s+(uur|stuks|exemplaren|op\s+voorraad)"
PRICE = r"(?i)(€|\bEUR\b)\s?\d[\d. ]*([.,]\d{1,2})?|\bvanaf\s+€"


def conversion_checks(records: DataFrame) -> DataFrame:
    """url, page_type and a pass from 0 to 1 per check; null where a check doesn't apply."""
    text, kind = F.col("page.text"), F.col("page_type")
    cta = lambda c: F.concat_ws(" ", c["text"], c["classes"]).rlike(_CTA)
    top = F.exists(F.slice("page.ctas", 1, 14), cta) | F.exists("page.ctas", lambda c: c["in_header"] & cta(c))
    h1 = F.size(F.filter("page.headings", lambda h: h["level"] == 1))
    largest = F.coalesce(F.array_max(F.transform("page.forms", lambda f: F.when(f["search"], 0).otherwise(f["fields"]))), F.lit(0))
    account = text.rlike(r"(?i)account\s+(is\s+)?(verplicht|vereist)|maak\s+(eerst\s+)?een\s+account|inloggen\s+(verplicht|vereist)")
    trust = sum((text.rlike(p).cast("double") for p in _TRUST), F.lit(0.0)) / 3
    passes = {
        "cta_fold": F.when(kind != "checkout", top.cast("double")),
        "one_message": F.when(kind.isin("home", "pdp"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.34 * (h1 - 1)))),
        "trust": F.when(kind == "pdp", trust),
        "checkout": F.when(kind == "checkout", F.greatest(F.lit(0.0), 1 - 0.7 * account.cast("double") - 0.4 * (largest > 10).cast("double"))),
        "price": F.when(kind == "pdp", text.rlike(PRICE).cast("double")),
        "urgency": F.when(text.rlike(_URGENT), 0.6).otherwise(1.0),
        "form_length": F.when(F.size("page.forms") > 0, F.when(largest > 7, 0.5).otherwise(1.0)),
    }
    return records.select("url", "page_type", *[v.alias(k) for k, v in passes.items()])


#: Heights of the first screen in pixels.
FOLD = {"desktop": 900, "mobile": 844}
_UNIT = r"(?i)\b\d+([.,]\d+)?\s?(km/?h|km|kg|watt|volt|ah|wh|cm|mm|nm|inch)\b"


def fold_checks(elements: DataFrame) -> DataFrame:
    """Rendered elements (url, viewport, tag, text, selector, fontSize, y, h) -> per page what its first screen shows.

    cta_fold weighs mobile twice; a viewport without any element isn't measured. hero_messages counts big texts on desktop;
    cta_min_44 is the share of calls to action 44 pixels high or more, over both viewports.
    """
    cta = F.concat_ws(" ", "text", "selector").rlike(_CTA) & F.lower("tag").isin("a", "button", "input")
    inside = {v: (F.col("viewport") == v) & (F.col("y") >= 0) & (F.col("y") < n) for v, n in FOLD.items()}
    any_of = lambda v, test: F.max(F.when(F.col("viewport") == v, (inside[v] & test).cast("double")))
    big = F.lower("tag").isin("h1", "h2") | ((F.col("fontSize") >= 20) & (F.length(F.trim("text")) > 0))
    by = elements.groupBy("url").agg(
        any_of("desktop", cta).alias("desktop"),
        any_of("mobile", cta).alias("mobile"),
        F.countDistinct(F.when(inside["desktop"] & big, F.lower(F.trim("text")))).alias("hero_messages"),
        F.avg(F.when(cta & (F.col("h") > 0), (F.col("h") >= 44).cast("double"))).alias("cta_min_44"),
        any_of("mobile", F.col("text").rlike(PRICE)).alias("price_fold"),
        any_of("mobile", F.col("text").rlike(_UNIT)).alias("unit_fold"),
    )
    fold = F.round(weighted((F.col("desktop"), 1.0), (F.col("mobile"), 2.0)), 4)
    return by.select(
        "url",
        fold.alias("cta_fold"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.25 * (F.col("hero_messages") - 3))).alias("one_message"),
        (F.col("mobile") > 0).alias("mobile_cta_fold"),
        "cta_min_44",
        ((F.col("price_fold") > 0) & (F.col("unit_fold") > 0)).alias("core_buy_fold_pdp"),
        "price_fold",
        "hero_messages",
    )


def conversion_issues(checks: DataFrame, urls: int = 6) -> DataFrame:
    """Per site and check: the pages that don't wholly pass it, the first `urls` of them and how many more there are."""
    names = [c for c in CONVERSION if c in checks.columns]
    rows = by_site(checks).unpivot(["site", "url"], names, "check", "pass").where("pass < 1")
    place = F.row_number().over(Window.partitionBy("site", "check").orderBy("url"))
    by = rows.withColumn("n", place).groupBy("site", "check").agg(
        F.count("*").alias("pages"), F.round(F.avg("pass"), 3).alias("mean_pass"), F.array_sort(F.collect_list(F.when(F.col("n") <= urls, F.col("url")))).alias("urls")
    )
    return by.withColumn("more", F.greatest(F.lit(0), F.col("pages") - urls))


@audit("conversion", 20)
def conversion(t: dict[str, DataFrame]) -> DataFrame:
    """Weighted mean of all checks of all pages; product pages count twice."""
    rows = conversion_checks(t["records"])
    twice = F.when(F.col("page_type") == "pdp", 2.0).otherwise(1.0)
    sums = [(F.sum(F.when(F.col(k).isNotNull(), twice * w * F.col(k))), F.sum(F.when(F.col(k).isNotNull(), twice * w))) for k, w in CONVERSION.items()]
    total = lambda i: sum((F.coalesce(s[i], F.lit(0.0)) for s in sums), F.lit(0.0))
    return by_site(rows).groupBy("site").agg(F.round(100 * total(0) / F.nullif(total(1), F.lit(0.0)), 1).alias("score"), F.count("*").alias("pages"))


#: Profile -> checks with their weights.
PROFILES = {
    "senior": {"body_font_18": 3, "tel_in_header": 2, "cta_min_44": 2, "no_countdown": 2, "sentences_short": 2, "help_findable": 1, "forms_short": 1},
    "commuter": {"mobile_cta_fold": 3, "spec_block_pdp": 2, "core_buy_fold_pdp": 2, "compare_feature": 1, "page_weight_ok": 1, "legal_info": 1},
    "mechanic": {"fit_signal_pdp": 3, "model_filter_plp": 2, "search_present": 2, "specs_delivery_pdp": 2, "stock_indication": 1},
    "generic": {"body_16": 2, "mobile_cta_fold": 2, "search_or_nav": 1, "contact_findable": 1},
}


def audience_checks(records: DataFrame) -> DataFrame:
    """url and true, false or null per check. Checks of the first screen are those of fold_checks(), where the records have its columns."""
    text, pdp = F.col("page.text"), F.col("page_type") == "pdp"
    size = F.col("body_font") if "body_font" in records.columns else F.lit(None).cast("double")
    search = F.exists("page.forms", lambda f: f["search"])
    tel = F.exists("page.links", lambda x: F.lower(x["href"]).startswith("tel:"))
    units = F.regexp_count(text, F.lit(r"(?i)\b\d+([.,]\d+)?\s?(km/?h|km|kg|watt|volt|ah|wh|cm|mm|nm|inch)\b"))
    checks = {
        "body_font_18": size >= 18, "body_16": size >= 16,
        "tel_in_header": F.exists("page.links", lambda x: x["in_boilerplate"] & F.lower(x["href"]).startswith("tel:")),
        "no_countdown": ~text.rlike(r"(?i)countdown|aftell|laatste kans|op\s*=\s*op|bijna uitverkocht|nog maar \d+|only \d+ left"),
        "sentences_short": F.when(F.col("word_count") > 60, (F.col("avg_words_per_sentence") <= 22) | F.coalesce(F.col("flesch") >= 50, F.lit(False))),
        "help_findable": text.rlike(r"(?i)keuzehulp|keuzewijzer|veelgestelde|\bfaq\b|hulp nodig|gratis advies"),
        "forms_short": F.when(F.size("page.forms") > 0, F.array_max(F.transform("page.forms", lambda f: f["fields"])) <= 5),
        "spec_block_pdp": F.when(pdp, (F.col("page.table_rows") >= 3) | (F.col("page.definitions") >= 3) | (units >= 4)),
        "compare_feature": text.rlike(r"(?i)vergelijk|compare|naast elkaar"),
        "page_weight_ok": F.col("size_kb") <= 4000 if "size_kb" in records.columns else F.lit(None).cast("boolean"),
        "fit_signal_pdp": F.when(pdp, text.rlike(r"(?i)past op|past bij|geschikt voor|compatib|onderdelen voor")),
        "search_present": search,
        "stock_indication": F.when(pdp, text.rlike(r"(?i)op voorraad|uitverkocht|leverbaar|levertijd")),
        "search_or_nav": search | (F.col("page.nav_links") >= 3) | (F.col("n_internal_links") >= 5),
        "contact_findable": tel | F.exists("page.links", lambda x: F.lower(x["href"]).startswith("mailto:") | F.lower(x["target"]).contains("contact")),
    }
    spec = checks["spec_block_pdp"]
    mobility = U.site(F.col("url")).rlike(r"(^|[^a-z])(e-?bike|fiets|scooter|step|brommer|mobility|moto)") | (F.regexp_count(text, F.lit(r"(?i)e-?bike|fatbike|scooter|brommer|elektrische step")) >= 2)
    plp = F.array_contains(U.page_tags(F.col("url"), F.lit(False)), "plp")
    checks |= {
        "legal_info": F.when(mobility, text.rlike(r"(?i)kenteken|rijbewijs|helmplicht|verzeker|openbare weg|rdw|typegoedkeuring")),
        "model_filter_plp": F.when(plp, F.exists("page.classes", lambda c: c.rlike(r"(?i)filter|facet")) | text.rlike(r"(?i)filter op|kies (je|uw) (model|merk)|sorteer")),
        "specs_delivery_pdp": F.when(pdp, spec & text.rlike(r"(?i)levertijd|leverbaar|bezorg|verzend|op voorraad|uitverkocht")),
        **{k: F.col(k).cast(kind) if k in records.columns else F.lit(None).cast(kind) for k, kind in (("mobile_cta_fold", "boolean"), ("cta_min_44", "double"), ("core_buy_fold_pdp", "boolean"))},
    }
    checks["core_buy_fold_pdp"] = F.when(pdp, checks["core_buy_fold_pdp"])
    return records.select("url", *[v.alias(k) for k, v in checks.items()])


def audience_score(records: DataFrame, profile: str = "generic") -> DataFrame:
    """Per site the weighted share of pages that pass, checkout pages aside; site-wide checks pass if any page does; what no page can measure is left out."""
    own = by_site(audience_checks(records.where("page_type is null or page_type <> 'checkout'")))
    anywhere = {"compare_feature", "search_present", "contact_findable", "legal_info"}
    share = lambda k: F.max(F.col(k).cast("double")) if k in anywhere else F.avg(F.col(k).cast("double"))
    by = own.groupBy("site").agg(*[share(k).alias(k) for k in PROFILES[profile]])
    return by.withColumn("score", F.round(100 * weighted(*[(F.col(k), float(w)) for k, w in PROFILES[profile].items()]), 1))


@audit("audience", 60)
def audience(t: dict[str, DataFrame]) -> DataFrame:
    return audience_score(t["records"])
