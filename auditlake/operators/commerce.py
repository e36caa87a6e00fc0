"""Commerce fields of JSON-LD product nodes: offers, policies, variants, stock, reviews, readiness for a merchant listing.

Takes the rows of records.nodes() (key, url, pos, type, keys, json). A node's JSON is parsed once into a VARIANT; where
schema.org allows one value or a list of them, both are read as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import number

#: Most variants and reviews of a page.
MOST_VARIANTS, MOST_REVIEWS = 60, 50


def parsed(found: DataFrame) -> DataFrame:
    return found.withColumn("v", F.try_parse_json("json"))


def _text(v: Column | str, *paths: str) -> Column:
    """The first path with a value that isn't empty, as text."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])


def _list(v: Column | str, path: str) -> Column:
    """A list, or one value, as an array of VARIANT; null if there is nothing."""
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(one.isNotNull() & ~F.is_variant_null(one), F.array(one)))


def _offer(*names: str) -> tuple[str, ...]:
    """Paths of the first offer's fields."""
    return tuple(f"$.offers{at}.{n}" for n in names for at in ("[0]", ""))


def _last(text: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.regexp_replace(text, "/+$", ""), "[/#]"), -1), F.lit(""))


def _variants(v: Column | str) -> Column:
    return _list(v, "$.hasVariant")


def _variant_price(x: Column) -> Column:
    return number(_text(x, "$.offers[0].price", "$.offers.price"))


def _offers() -> Column:
    """count, low and high of several offers: an aggregate offer, a list, or a group's variants."""
    offers, variants = F.try_variant_get("v", "$.offers", "array<variant>"), _variants("v")
    prices = lambda rows, price: F.filter(F.transform(rows, price), lambda p: p.isNotNull())
    listed, varied = prices(offers, lambda x: number(_text(x, "$.price"))), prices(variants, _variant_price)
    aggregate = (_text("v", "$.offers['@type']") == "AggregateOffer") | _text("v", "$.offers.offerCount").isNotNull() | (_text("v", "$.offers.lowPrice").isNotNull() & _text("v", "$.offers.highPrice").isNotNull())
    made = lambda n, low, high: F.struct(n.cast("int").alias("count"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    none = F.lit(None)
    return (
        F.when(F.coalesce(aggregate, F.lit(False)), made(number(_text("v", "$.offers.offerCount")), number(_text("v", "$.offers.lowPrice")), number(_text("v", "$.offers.highPrice"))))
        .when(F.size(offers) > 1, made(F.size(offers), F.array_min(listed), F.array_max(listed)))
        .when(F.size(variants) > 1, made(F.size(variants), F.array_min(varied), F.array_max(varied)))
        .when(F.try_variant_get("v", "$.offers", "variant").isNotNull(), made(F.lit(1), none, none))
        .otherwise(made(none, none, none))
    )


def details(found: DataFrame) -> DataFrame:
    """One row a product node: identifiers, prices, condition, several offers, shipping, returns, stock, readiness."""
    both = lambda *names: _text("v", *[f"$.{n}" for n in names], *[p for n in names for p in _offer(n)])
    first = lambda field: [f"$.{at}{field}{one}" for at in ("offers[0].", "offers.", "") for one in ("[0]", "")]
    shipping, returns = first("shippingDetails"), first("hasMerchantReturnPolicy")
    price = number(_text("v", *_offer("price", "lowPrice")))
    spec = F.coalesce(_list("v", "$.offers[0].priceSpecification"), _list("v", "$.offers.priceSpecification"))
    marked = F.filter(spec, lambda x: F.lower(_text(x, "$.priceType")).rlike("list_?price"))
    dearer = [F.when(p > price, p) for p in (number(_text(F.get(marked, F.lit(0)), "$.price")), number(_text("v", *_offer("listPrice"), "$.listPrice")), number(_text("v", *_offer("highPrice"))))]
    own = parsed(found.where("type in ('product', 'productgroup')")).select(
        "key",
        "url",
        "pos",
        "type",
        "v",
        both("gtin", "gtin14", "gtin8").alias("gtin"),
        both("gtin13").alias("gtin13"),
        both("mpn").alias("mpn"),
        both("upc", "gtin12").alias("upc"),
        both("ean").alias("_ean"),
        price.alias("price"),
        F.coalesce(*dearer).alias("compare_at_price"),
        _text("v", *_offer("priceCurrency")).alias("currency"),
        _last(_text("v", *_offer("availability"))).alias("availability"),
        _text("v", *_offer("priceValidUntil")).alias("price_valid_until"),
        _last(_text("v", *_offer("itemCondition"), "$.itemCondition")).alias("condition"),
        _offers().alias("multiple_offers"),
        _text("v", *shipping).isNotNull().alias("has_shipping"),
        number(_text("v", *[f"{p}.shippingRate{x}.value" for p in shipping for x in ("[0]", "")])).alias("shipping_rate"),
        _text("v", *[f"{p}.shippingDestination{x}.addressCountry{y}" for p in shipping for x in ("[0]", "") for y in (".name", "")]).alias("shipping_country"),
        _text("v", *returns).isNotNull().alias("has_returns"),
        number(_text("v", *[f"{p}.merchantReturnDays" for p in returns])).alias("return_days"),
        _last(_text("v", *[f"{p}.returnPolicyCategory" for p in returns])).alias("return_policy"),
        number(_text("v", *_offer("inventoryLevel.value", "inventoryLevel"), "$.inventoryLevel.value", "$.inventoryLevel")).alias("stock_count"),
        _text("v", "$.name").alias("name"),
        _text("v", "$.brand.name", "$.brand").alias("brand"),
        _text("v", "$.image").isNotNull().alias("_image"),
    )
    sixteen = F.when(F.length("gtin") == 13, F.col("gtin"))
    own = own.withColumn("ean", F.coalesce("_ean", "gtin13", sixteen))
    own = own.withColumn("sale_price", F.when(F.col("compare_at_price").isNotNull(), F.col("price")))
    own = own.withColumn("shipping_free", F.col("shipping_rate") == 0)
    own = own.withColumn("has_gtin", F.coalesce("gtin", "gtin13", "ean", "upc").isNotNull())
    ready = F.col("name").isNotNull() & F.col("_image") & F.col("price").isNotNull() & F.col("currency").isNotNull() & F.col("availability").isNotNull()
    return own.withColumn("merchant_listing_ready", ready).drop("v", "_ean", "_image")


def primary(found: DataFrame) -> DataFrame:
    """Per page its main product's details: a group with offers before any node with offers before the first, variants last."""
    own = parsed(found.where("type in ('product', 'productgroup')"))
    inside = own.select("key", F.explode(F.transform(_variants("v"), lambda x: F.to_json(x))).alias("json")).distinct().withColumn("variant", F.lit(True))
    # A variant is compared as the parsed value that it is, since its own row holds other white space.
    rows = own.withColumn("json", F.to_json("v")).join(inside, ["key", "json"], "left")
    offered = F.try_variant_get("v", "$.offers", "variant").isNotNull()
    rank = F.when(F.col("variant"), 3).when((F.col("type") == "productgroup") & offered, 0).when(offered, 1).otherwise(2)
    chosen = rows.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "pos", "type")).alias("m")).select("key", "m.pos", "m.type")
    return details(found).join(chosen, ["key", "pos", "type"])


def variants(found: DataFrame, most: int = MOST_VARIANTS) -> DataFrame:
    """One row a variant of a product or group, the first `most` of a page: name, sku, price, colour, size, the axes on which they vary."""
    own = parsed(found.where("type in ('product', 'productgroup')"))
    axis = lambda a: F.lower(_last(F.try_variant_get(a, "$", "string")))
    named = lambda a: F.when(axis(a).rlike("colou?r|kleur"), "kleur").when(axis(a).rlike("size|maat"), "maat").otherwise(axis(a))
    axes = F.array_sort(F.array_distinct(F.array_compact(F.transform(_list("v", "$.variesBy"), named))))
    rows = own.select("key", "pos", axes.alias("varies_by"), F.posexplode(_variants("v")).alias("at", "x"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("pos", "at"))
    extra = lambda x, names: _text(F.get(F.filter(_list(x, "$.additionalProperty"), lambda p: F.lower(_text(p, "$.name")).isin(*names)), F.lit(0)), "$.value")
    return rows.withColumn("n", place).where(F.col("n") <= most).select(
        "key",
        "n",
        _text("x", "$.name").alias("name"),
        _text("x", "$.sku").alias("sku"),
        _variant_price(F.col("x")).alias("price"),
        F.coalesce(_text("x", "$.color"), extra("x", ("color", "kleur"))).alias("kleur"),
        F.coalesce(_text("x", "$.size"), extra("x", ("size", "maat"))).alias("maat"),
        "varies_by",
    )


def reviews(found: DataFrame, most: int = MOST_REVIEWS) -> DataFrame:
    """Reviews of products and loose ones, distinct by author, rating, date and the text's beginning, the first `most` of a page."""
    own = parsed(found.where("type in ('product', 'productgroup', 'review')"))
    whole = F.when(F.col("type") == "review", F.array("v")).otherwise(_list("v", "$.review"))
    rows = own.select("key", "pos", F.posexplode(whole).alias("at", "x")).select(
        "key",
        "pos",
        "at",
        _text("x", "$.author[0].name", "$.author.name", "$.author").alias("author"),
        number(_text("x", "$.reviewRating.ratingValue", "$.reviewRating", "$.ratingValue")).alias("rating"),
        _text("x", "$.datePublished", "$.dateCreated").alias("date"),
        F.substring(F.trim(_text("x", "$.reviewBody", "$.description")), 1, 1000).alias("body"),
    )
    first = rows.groupBy("key", "author", "rating", "date", F.substring("body", 1, 60).alias("_start")).agg(F.min(F.struct("pos", "at", "body")).alias("m"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("m.pos", "m.at"))
    return first.withColumn("n", place).where(F.col("n") <= most).select("key", "n", "author", "rating", "date", F.col("m.body").alias("body"))


def microdata(pages: DataFrame, key: str) -> DataFrame:
    """Products of microdata with a name, in the columns of products()."""
    own = pages.select(F.col(key).cast("string").alias("key"), "url", F.posexplode("page.items").alias("pos", "i")).where("lower(i.type) = 'product'")
    prop = lambda *names: F.coalesce(*[F.nullif(F.element_at("i.props", F.lit(n)), F.lit("")) for n in names])
    return own.select(
        "key",
        "url",
        "pos",
        F.lit("microdata").alias("source"),
        prop("name").alias("name"),
        prop("brand").alias("brand"),
        prop("sku").alias("sku"),
        prop("gtin13", "gtin").alias("gtin"),
        number(prop("price")).alias("price"),
        prop("priceCurrency").alias("currency"),
        _last(prop("availability")).alias("availability"),
        number(prop("ratingValue")).alias("rating"),
        number(prop("reviewCount")).alias("rating_count"),
    ).where("name is not null")


def all_products(jsonld: DataFrame, items: DataFrame) -> DataFrame:
    """Products of records.products() and of microdata(), repeats included: UNION ALL."""
    own = jsonld.withColumn("source", F.lit("jsonld"))
    return own.select(*items.columns).unionByName(items)


def stock_in_text(text: Column) -> Column:
    """The number of pieces that a page's text says are left."""
    pattern = r"(?i)(?:nog|nog maar|laatste)\s+(\d{1,4})\s+(?:stuks?|op voorraad|beschikbaar|in voorraad)"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")


#: What shows visitors a rating: a score out of five, a number of reviews, stars, or a class that is named so.
SEEN_TEXT = r"\b\d(?:[.,]\d)?\s*(?:/|van|uit|out of)\s*5\b|\b\d{1,7}\s*(?:reviews?|beoordelingen|recensies|ratings?|sterren|stars?)\b|[★⭐☆]"
SEEN_CLASS = r"(?i)star|rating|review|beoordel"


def rating_flags(found: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Pages whose ratings look made up, with the reasons: out of scale, a count of none or an absurd one, or no rating to be seen."""
    own = parsed(found)
    rating = F.when(F.col("type") == "aggregaterating", F.col("v")).when(F.col("type") == "review", F.try_variant_get("v", "$.reviewRating", "variant")).otherwise(F.try_variant_get("v", "$.aggregateRating", "variant"))
    rows = own.withColumn("r", rating).where("r is not null").select(
        "key",
        number(_text("r", "$.ratingValue")).alias("value"),
        F.coalesce(F.nullif(number(_text("r", "$.bestRating")), F.lit(0.0)), F.lit(5.0)).alias("best"),
        F.coalesce(number(_text("r", "$.worstRating")), F.lit(0.0)).alias("worst"),
        number(_text("r", "$.reviewCount", "$.ratingCount")).alias("n"),
    )
    any_of = lambda test: F.max(F.coalesce(test, F.lit(False)))
    by = rows.groupBy("key").agg(any_of((F.col("value") > F.col("best")) | (F.col("value") < F.col("worst"))).alias("scale"), any_of(F.col("n") == 0).alias("none"), any_of(F.col("n") > 5_000_000).alias("absurd"))
    classes = F.exists("page.classes", lambda c: c.rlike(SEEN_CLASS))
    props = F.exists("page.items", lambda i: F.arrays_overlap(F.map_keys(i["props"]), F.array(*[F.lit(x) for x in ("ratingValue", "reviewCount", "ratingCount")])))
    seen = pages.select(F.col(key).cast("string").alias("key"), (F.col("page.raw_text").rlike(SEEN_TEXT) | classes | props).alias("seen"))
    joined = by.join(seen, "key", "left")
    said = (("scale", "rating_buiten_schaal"), ("none", "count_nul"), ("absurd", "count_absurd"))
    reasons = F.array_compact(F.array(*[F.when(F.col(c), F.lit(x)) for c, x in said], F.when(F.col("seen") == F.lit(False), F.lit("geen_zichtbare_rating"))))
    return joined.select("key", reasons.alias("reasons")).where(F.size("reasons") > 0)


#: Words for out of stock and in stock.
GONE = ("uitverkocht", "niet op voorraad", "niet leverbaar", "out of stock", "sold out")
THERE = ("op voorraad", "in stock", "direct leverbaar", "leverbaar", "beschikbaar")


def drift(found: DataFrame, pages: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Prices, availabilities and ratings of the schema that the page's text doesn't bear out, at most `most` a page."""
    own = parsed(found)
    text = pages.select(F.col(key).cast("string").alias("key"), F.lower("page.raw_text").alias("text"))
    offered = F.col("type").isin("product", "offer")
    price = F.when(F.col("type") == "offer", _text("v", "$.price", "$.lowPrice")).otherwise(_text("v", *_offer("price", "lowPrice")))
    stock = F.when(F.col("type") == "offer", _text("v", "$.availability")).otherwise(_text("v", *_offer("availability")))
    rated = F.when(F.col("type") == "aggregaterating", _text("v", "$.ratingValue")).otherwise(_text("v", "$.aggregateRating.ratingValue"))
    fields = F.array(
        F.struct(F.lit("price").alias("field"), F.when(offered, price).alias("schema")),
        F.struct(F.lit("availability").alias("field"), F.when(offered, F.lower(stock)).alias("schema")),
        F.struct(F.lit("rating").alias("field"), rated.alias("schema")),
    )
    rows = own.select("key", "pos", F.posexplode(fields).alias("at", "f")).select("key", "pos", "at", "f.*").where("schema is not null").join(text, "key")
    shown = F.transform(F.regexp_extract_all("text", F.lit(r"\d{1,4}(?:[.,]\d{3})*[.,]\d{2}(?!\d)"), F.lit(0)), number)
    near = F.exists(shown, lambda x: (F.round(x, 2) == F.round(number(F.col("schema")), 2)) | (F.round(x) == F.round(number(F.col("schema")))))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("text", w))
    gone, there = has(GONE), has(THERE)
    wrong = (
        F.when(F.col("field") == "price", number(F.col("schema")).isNotNull() & ~near)
        .when(F.col("field") == "availability", (F.contains("schema", F.lit("instock")) & gone & ~there) | (F.col("schema").rlike("outofstock|soldout") & there & ~gone))
        .otherwise(~F.contains("text", F.col("schema")) & ~F.contains("text", F.replace("schema", F.lit("."), F.lit(","))))
    )
    place = F.row_number().over(Window.partitionBy("key").orderBy("pos", "at"))
    return rows.where(wrong).withColumn("n", place).where(F.col("n") <= most).select("key", "n", "field", "schema")


def brand_signals(found: DataFrame) -> DataFrame:
    """Per page: an organisation, whether it names other profiles and a logo, and all three."""
    own = parsed(found).withColumn("org", F.col("type").isin("organization", "localbusiness") | F.col("type").endswith("business"))
    has = lambda field: F.bool_or(F.col("org") & _text("v", f"$.{field}").isNotNull())
    by = own.groupBy("key").agg(F.bool_or("org").alias("has_organization"), has("sameAs").alias("has_sameas"), has("logo").alias("has_logo"))
    return by.withColumn("knowledge_graph_ready", F.col("has_organization") & F.col("has_sameas") & F.col("has_logo"))


def breadcrumbs(found: DataFrame) -> DataFrame:
    """Per page the names of its first breadcrumb list that has any, in order."""
    own = parsed(found.where("type = 'breadcrumblist'"))
    names = F.filter(F.transform(_list("v", "$.itemListElement"), lambda x: _text(x, "$.name", "$.item.name")), lambda n: n.isNotNull())
    rows = own.select("key", "pos", names.alias("names")).where(F.size("names") > 0)
    return rows.groupBy("key").agg(F.min_by("names", "pos").alias("breadcrumbs"))


def types_of(found: DataFrame) -> DataFrame:
    """Per page its sorted distinct types as the documents write them; a list of types is one, in its own notation."""
    own = parsed(found).select("key", F.try_variant_get("v", "$['@type']", "array<string>").alias("many"), _text("v", "$['@type']").alias("one"))
    listed = F.concat(F.lit("['"), F.array_join("many", "', '"), F.lit("']"))
    kind = F.when(F.col("many").isNotNull(), listed).otherwise(F.col("one"))
    return own.select("key", kind.alias("t")).groupBy("key").agg(F.array_sort(F.collect_set("t")).alias("jsonld_types"))
