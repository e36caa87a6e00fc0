"""Queries over products: JSON-LD written from `part`, parsed again by the commerce operators, with the sums in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commerce, facts, records
from ..sources import speed
from .catalog import query, table

_PRODUCT = """to_json(named_struct(
 '@type', 'Product', 'name', p_name, 'brand', named_struct('name', p_brand), 'sku', concat('SKU-', p_partkey),
 'gtin13', if(p_partkey % 3 = 0, lpad(cast(p_partkey as string), 13, '0'), null), 'image', if(p_partkey % 5 = 0, null, array('a.jpg')),
 'offers', if(p_size % 4 = 0, null, transform(sequence(1, greatest(1, p_size % 4)), i -> named_struct(
   'price', cast(cast(p_retailprice + i as decimal(12,2)) as string), 'priceCurrency', 'EUR', 'availability', if(p_partkey % 2 = 0, 'https://schema.org/InStock', 'https://schema.org/OutOfStock'),
   'itemCondition', 'https://schema.org/NewCondition', 'listPrice', if(p_partkey % 4 = 1, cast(p_retailprice + 10 as decimal(12,2)), null),
   'inventoryLevel', named_struct('value', p_size), 'shippingDetails', named_struct('shippingRate', named_struct('value', p_size % 10), 'shippingDestination', named_struct('addressCountry', 'NL')),
   'hasMerchantReturnPolicy', if(p_size % 2 = 0, named_struct('merchantReturnDays', 14 + p_size % 3, 'returnPolicyCategory', 'https://schema.org/Finite'), null)))),
 'variesBy', array('https://schema.org/color', 'size'),
 'hasVariant', if(p_size % 3 = 0, null, transform(sequence(1, greatest(1, p_size % 3)), i -> named_struct('@type', 'Offer', 'name', concat(p_name, ' ', i), 'sku', concat('V', p_partkey, '-', i), 'color', p_type,
   'offers', named_struct('price', i * 10), 'additionalProperty', array(named_struct('name', 'Maat', 'value', concat('M', i)))))),
 'review', if(p_size % 5 = 0, null, transform(sequence(1, greatest(1, p_size % 5)), i -> named_struct('author', named_struct('name', concat('A', i % 2)), 'reviewRating', named_struct('ratingValue', i % 2 + 3), 'datePublished', '2024-01-01', 'reviewBody', ' fine '))),
 'aggregateRating', if(p_size % 6 = 0, null, named_struct('ratingValue', p_size % 7, 'reviewCount', p_size % 3))))"""


def _pages(spark, sf_dir):
    """A page a part: its product as JSON-LD, and text that shows the price of some and a rating on others."""
    own = table(spark, sf_dir, "part").withColumn("doc", F.expr(_PRODUCT))
    text = F.expr("concat(p_name, if(p_partkey % 2 = 0, concat(' ', cast(cast(p_retailprice + 1 as decimal(12,2)) as string), ' eur, op voorraad'), ' uitverkocht'), if(p_size % 3 = 1, ' 12 reviews', ''))")
    return own.select("p_partkey", F.concat(F.lit("https://shop.example/"), "p_partkey").alias("url"), F.struct(F.array("doc").alias("jsonld"), text.alias("raw_text"), F.array().cast("array<string>").alias("classes"), F.array().cast("array<struct<type:string,props:map<string,string>>>").alias("items")).alias("page"))


def _nodes(spark, sf_dir):
    return records.nodes(_pages(spark, sf_dir), "p_partkey")


def _keyed(df):
    return df.withColumn("p_partkey", F.col("key").cast("long")).drop("key")


@query("""select p_partkey, p_name "name", p_brand brand, case when p_partkey % 3 = 0 then lpad(p_partkey::varchar, 13, '0') end gtin13,
  case when p_size % 4 <> 0 then round(p_retailprice + 1, 2) end price, case when p_size % 4 <> 0 and p_partkey % 4 = 1 then round(p_retailprice + 10, 2) end compare_at_price,
  case when p_size % 4 <> 0 and p_partkey % 4 = 1 then round(p_retailprice + 1, 2) end sale_price, case when p_size % 4 <> 0 then 'NewCondition' end "condition",
  case when p_size % 4 > 1 then p_size % 4 when p_size % 3 = 2 then 2 when p_size % 4 = 1 then 1 end::int n_offers,
  case when p_size % 4 > 1 then round(p_retailprice + 1, 2) when p_size % 3 = 2 then 10.0::double end low,
  case when p_size % 4 > 1 then round(p_retailprice + p_size % 4, 2) when p_size % 3 = 2 then 20.0::double end high,
  p_partkey % 3 = 0 has_gtin, p_partkey % 5 <> 0 and p_size % 4 <> 0 merchant_listing_ready from part""")
def product_offers(spark, sf_dir):
    own = _keyed(commerce.primary(_nodes(spark, sf_dir)))
    offers = [F.col(f"multiple_offers.{c}") for c in ("count", "low", "high")]
    money = [F.round(c, 2).alias(c) for c in ("price", "compare_at_price", "sale_price")]
    return own.select("p_partkey", "name", "brand", "gtin13", *money, "condition", offers[0].alias("n_offers"), F.round(offers[1], 2).alias("low"), F.round(offers[2], 2).alias("high"), "has_gtin", "merchant_listing_ready")


@query("""select p_partkey, p_size % 4 <> 0 has_shipping, case when p_size % 4 <> 0 then p_size % 10 end::double shipping_rate, case when p_size % 4 <> 0 then p_size % 10 = 0 end shipping_free,
  case when p_size % 4 <> 0 then 'NL' end shipping_country, p_size % 4 = 2 has_returns, case when p_size % 4 = 2 then 14 + p_size % 3 end::double return_days,
  case when p_size % 4 = 2 then 'Finite' end return_policy, case when p_size % 4 <> 0 then p_size end::double stock_count from part""")
def product_policies(spark, sf_dir):
    names = ("has_shipping", "shipping_rate", "shipping_free", "shipping_country", "has_returns", "return_days", "return_policy", "stock_count")
    return _keyed(commerce.details(_nodes(spark, sf_dir))).select("p_partkey", *names)


@query("""with v as (select *, unnest(range(1, p_size % 3 + 1)) i from part)
select p_partkey, i::int n, p_name || ' ' || i "name", 'V' || p_partkey || '-' || i sku, i * 10.0::double price, p_type kleur, 'M' || i maat, 'kleur,maat' varies_by from v""")
def product_variants(spark, sf_dir):
    return _keyed(commerce.variants(_nodes(spark, sf_dir))).withColumn("varies_by", F.array_join("varies_by", ","))


@query("""with r as (select distinct p_partkey, unnest(range(1, p_size % 5 + 1)) % 2 a from part)
select p_partkey, (row_number() over (partition by p_partkey order by a desc))::int n, 'A' || a author, a + 3.0::double rating, '2024-01-01' "date", 'fine' body from r""")
def product_reviews(spark, sf_dir):
    return _keyed(commerce.reviews(_nodes(spark, sf_dir)))


@query("""select p_partkey, array_to_string(list_filter([case when p_size % 7 > 5 then 'rating_buiten_schaal' end, case when p_size % 3 = 0 then 'count_nul' end, case when p_size % 3 <> 1 then 'geen_zichtbare_rating' end], lambda x: x is not null), ',') reasons
from part where p_size % 6 <> 0 and (p_size % 7 > 5 or p_size % 3 <> 1)""")
def rating_flags(spark, sf_dir):
    return _keyed(commerce.rating_flags(_nodes(spark, sf_dir), _pages(spark, sf_dir), "p_partkey")).withColumn("reasons", F.array_join("reasons", ","))


@query("""select p_partkey, 'price' field from part where p_size % 4 <> 0 and p_partkey % 2 = 1""")
def price_drift(spark, sf_dir):
    """Prices that the page's text doesn't show. (Availability agrees with the text by the way the pages are made.)"""
    own = commerce.drift(_nodes(spark, sf_dir), _pages(spark, sf_dir), "p_partkey").where("field = 'price'")
    return _keyed(own).select("p_partkey", "field").distinct()


_REPORT = """to_json(named_struct('loadingExperience', named_struct('metrics', named_struct('LARGEST_CONTENTFUL_PAINT_MS', named_struct('percentile', p_size * 100, 'category', if(p_size < 20, 'FAST', 'SLOW')))),
 'lighthouseResult', named_struct('audits', named_struct('largest-contentful-paint', named_struct('numericValue', p_retailprice), 'cumulative-layout-shift', named_struct('numericValue', p_size / 128.0D),
  'total-byte-weight', named_struct('numericValue', p_partkey * 100), 'network-requests', named_struct('details', named_struct('items', sequence(1, p_size))),
  'unused-css-rules', named_struct('details', named_struct('overallSavingsBytes', p_size * 512)), 'uses-text-compression', named_struct('score', p_size % 2)), 'categories', named_struct('performance', named_struct('score', p_size / 100.0D)))))"""


@query("""select p_partkey, (p_size * 100)::double lcp_field, case when p_size < 20 then 'good' else 'poor' end lcp_category, round_even(p_retailprice, 0)::bigint lcp, round(p_size / 128.0::double, 3) cls,
  (p_partkey * 100)::bigint total_byte_weight, round(p_partkey * 100 / 1024.0::double, 1) page_size_total_kb, p_size::int network_requests, round(p_size * 512 / 1024.0::double, 1) unused_css_kb, p_size % 2 = 1 uses_text_compression,
  p_size::bigint performance_score from part""")
def speed_fields(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("url"), F.lit("mobile").alias("strategy"), F.expr(_REPORT).alias("json"))
    return speed.fields(own).select(
        F.col("url").cast("long").alias("p_partkey"), F.col("lcp_field.percentile").alias("lcp_field"), F.col("lcp_field.category").alias("lcp_category"), "lcp", "cls", "total_byte_weight", "page_size_total_kb",
        "network_requests", "unused_css_kb", "uses_text_compression", "performance_score",
    )


@query("""with i as (select 'https://img.example/' || (p_partkey % 500) || case when p_size % 3 = 0 then '.webp' when p_size % 3 = 1 then '.jpg' else '' end src, p_partkey::varchar url from part),
c as (select distinct src, split_part(src, '/', 4) f from i),
k as (select src, regexp_extract(f, '^\\d+')::int k, regexp_extract(f, '\\.(\\w+)$', 1) ext from c)
select url, i.src, case when k.k % 11 = 0 then 404 else 200 end::int status, case when ext <> '' then ext else 'png' end format, coalesce(ext in ('webp', 'avif', 'jxl'), false) next_gen,
  round(nullif(k.k * 600, 0) / 1024.0::double, 1) filesize_kb, coalesce(round(nullif(k.k * 600, 0) / 1024.0::double, 1) > 100, false) oversized, k.k % 11 = 0 broken from i join k on k.src = i.src""".replace("\\\\", "\\"))
def image_checks(spark, sf_dir):
    """Images of parts joined with probes of their files."""
    name = F.expr("concat('https://img.example/', p_partkey % 500, case p_size % 3 when 0 then '.webp' when 1 then '.jpg' else '' end)")
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("url"), name.alias("src"))
    number = F.regexp_extract("url", r"/(\d+)[^/]*$", 1).cast("int")
    probes = images.select(F.col("src").alias("url")).distinct().select(
        "url", F.when(number % 11 == 0, 404).otherwise(200).alias("status"), F.lit("image/png; x").alias("content_type"), (number * 600).alias("content_length")
    )
    return facts.image_checks(images, probes)
