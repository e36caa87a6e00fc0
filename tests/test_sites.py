"""Operators on products, sites, files and pixels, on hand-made rows; the registered ones are also held against SQL."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import audits, commerce, facts, pixels, records, scoring, silos
from auditlake.sources import reports, speed, tables


@pytest.fixture(scope="module")
def shop(spark):
    docs = [
        {"@type": "Product", "name": "N", "brand": {"name": "B"}, "image": ["i"], "aggregateRating": {"ratingValue": 6, "reviewCount": 0},
         "offers": [{"price": "1.234,50", "priceCurrency": "EUR", "availability": "https://schema.org/InStock", "listPrice": 2000}, {"price": 5}],
         "review": {"author": "A", "reviewRating": {"ratingValue": 5}, "reviewBody": " ok "}},
        {"@type": "ProductGroup", "variesBy": ["https://schema.org/color", "size"], "hasVariant": [{"@type": "Product", "name": "v1", "offers": {"price": 3}}, {"@type": "Product", "name": "v2", "offers": {"price": 4}, "additionalProperty": [{"name": "Maat", "value": "L"}]}]},
        {"@type": "BreadcrumbList", "itemListElement": [{"name": "a"}, {"item": {"name": "b"}}]},
        {"@type": "Organization", "sameAs": ["x"], "logo": "l"},
    ]
    rows = spark.createDataFrame([(1, "u", [json.dumps(d) for d in docs])], "id long, url string, j array<string>")
    items = F.expr("array(named_struct('type', 'Product', 'props', map('name', 'm', 'price', '3,5')))")
    page = F.struct(F.col("j").alias("jsonld"), F.lit("1.234,50 uitverkocht").alias("raw_text"), F.array(F.lit("x")).alias("classes"), items.alias("items"))
    return rows.select("id", "url", page.alias("page"))


def test_products(shop):
    found = records.nodes(shop, "id").cache()
    main = commerce.primary(found).first()
    assert (main["name"], main["price"], main["compare_at_price"], main["sale_price"], main["multiple_offers"]["low"]) == ("N", 1234.5, 2000.0, 1234.5, 5.0)
    assert main["merchant_listing_ready"] and not main["has_gtin"] and not main["has_shipping"]
    group = commerce.details(found).where("type = 'productgroup'").first()["multiple_offers"]
    assert (group["count"], group["low"], group["high"]) == (2, 3.0, 4.0)
    assert [(r["name"], r["maat"], r["varies_by"]) for r in commerce.variants(found).orderBy("n").collect()] == [("v1", None, ["kleur", "maat"]), ("v2", "L", ["kleur", "maat"])]
    assert [r["body"] for r in commerce.reviews(found).collect()] == ["ok"]
    assert commerce.breadcrumbs(found).first()["breadcrumbs"] == ["a", "b"] and commerce.brand_signals(found).first()["knowledge_graph_ready"]
    assert commerce.rating_flags(found, shop, "id").first()["reasons"] == ["rating_buiten_schaal", "count_nul", "geen_zichtbare_rating"]
    wrong = {(r["field"], r["schema"]) for r in commerce.drift(found, shop, "id").collect()}
    assert ("availability", "https://schema.org/instock") in wrong and ("price", "1.234,50") not in wrong and ("rating", "6") in wrong
    assert commerce.all_products(records.products(found), commerce.microdata(shop, "id")).where("source = 'microdata'").first()["price"] == 3.5


def test_links_of_sites(spark):
    pages = spark.createDataFrame(
        [("https://a.nl/", "Home"), ("https://a.nl/gids/fiets-kopen", "Fiets kopen gids"), ("https://a.nl/producten", "Producten"), ("https://a.nl/producten/fiets-x2", "Fiets X2 | A"), ("https://b.nl/privacy", "Privacy")],
        "url string, title string",
    ).withColumn("h1", F.col("title")).withColumn("word_count", F.lit(100))
    links = [("https://a.nl/", "https://a.nl/gids/fiets-kopen", "Lees meer »"), ("https://a.nl/producten/fiets-x2", "https://a.nl/producten", "Alle producten"), ("https://a.nl/", "https://a.nl/producten", "hier")]
    t = {"pages": pages, "edges": spark.createDataFrame(links, "src string, dst string, anchor string").withColumn("is_boiler", F.lit(False))}
    found = {r["silo"]: r for r in silos.silos(silos.nodes(t)).where("site = 'a.nl'").collect()}
    assert found["product"]["hub"] == "https://a.nl/producten" and found["product"]["commercial"] and found["gids"]["hub"] is None and "(home)" in found
    row = {r["site"]: r for r in silos.scores(t).collect()}["a.nl"]
    assert (row["anchor"], row["guide_link"], row["silo"], row["orphan"]) == (33.3, 0.0, 75.0, 75.0)
    assert [r["shop"] for r in silos.guide_targets(t).where("place = 1").collect()] == ["https://a.nl/producten/fiets-x2"]
    plan = silos.link_plan(t).where("site = 'a.nl'").orderBy("place").collect()
    assert plan[0]["node"].startswith("https://a.nl/producten") and any("Fiets X2" in r["anchors"] for r in plan)
    ranks = spark.createDataFrame([("https://b.nl/privacy", 0.6), ("https://b.nl/x", 0.3), ("https://b.nl/y", 0.1)], "node string, pagerank double")
    assert silos.pagerank_scores({"ranks": ranks}).first()["pagerank"] == 70 - 40 * 0.6


def test_titles_are_counted_per_site(spark):
    rows = spark.createDataFrame([("https://a.nl/1", "Home"), ("https://a.nl/2", "home "), ("https://b.nl/1", "Home"), ("https://b.nl/2", None), ("https://b.nl/3", "")], "url string, title string")
    assert {r["url"][8:]: r["title_copies"] for r in scoring.prepared(rows).collect()} == {"a.nl/1": 2, "a.nl/2": 2, "b.nl/1": 1, "b.nl/2": 1, "b.nl/3": 1}


def test_audits_keep_sites_apart(spark):
    pages = spark.createDataFrame([("https://a.nl/1",), ("https://a.nl/2",), ("https://b.nl/1",)], "url string")
    shown = audits.run_all({"pages": pages, "render_texts": pages.where("url like '%/1'")}, spark).where("name = 'render_coverage'").collect()
    assert {r["site"]: r["score"] for r in shown} == {"a.nl": 50.0, "b.nl": 100.0}


def test_first_screen(spark):
    rows = [("u", "desktop", "a", "Bestel nu", "a.btn", 16.0, 100, 50), ("u", "mobile", "a", "Bestel nu", "a.btn", 16.0, 1000, 40), ("u", "desktop", "h1", "Titel", "h1", 30.0, 10, 40)]
    got = audits.fold_checks(spark.createDataFrame(rows, "url string, viewport string, tag string, text string, selector string, fontSize double, y int, h int")).first()
    assert (got["cta_fold"], got["mobile_cta_fold"], got["cta_min_44"], got["hero_messages"], got["one_message"]) == (0.3333, False, 0.5, 1, 1.0)


def test_facts(spark):
    urls = ["https://a.nl/x/p00.cut.webp?v=1", "https://a.nl/x/p00.cut.webp?v=2", "https://a.nl/"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", facts.safe_name(F.col("url")).alias("n"), facts.page_slug(F.col("url")).alias("s")).collect()
    names = {r["url"]: r["n"] for r in rows}
    assert names[urls[0]].startswith("p00.cut_") and names[urls[0]].endswith(".webp") and names[urls[0]] != names[urls[1]] and names[urls[2]].startswith("img_")
    assert {r["s"] for r in rows} == {"x_p00.cut.webp", "home"}
    images = spark.createDataFrame([(urls[0],), ("https://a.nl/q.png",)], "src string")
    files = spark.createDataFrame([(names[urls[0]],), ("q.webp",)], "name string")
    assert {r["src"]: r["file"] for r in facts.local_files(images, files).collect()} == {urls[0]: names[urls[0]], "https://a.nl/q.png": "q.webp"}
    texts = spark.createDataFrame([("u", "stored")], "url string, text string")
    got = facts.with_text(spark.createDataFrame([("u", "T", "H"), ("v", "T", "H")], "url string, title string, h1 string"), texts).collect()
    assert {r["url"]: r["text"] for r in got} == {"u": "stored", "v": "T H"}


def test_pixels(spark):
    image = np.full((40, 60, 3), 255, np.uint8)
    image[10:30, 20:50] = (10, 20, 30)
    cut = np.zeros((20, 20, 4), np.uint8)
    cut[5:15, 5:15] = 255
    rows = [("a", 60, 40, 3, bytearray(image.tobytes())), ("b", 20, 20, 4, bytearray(cut.tobytes())), ("c", 9, 9, 3, bytearray(b"x")), ("d", None, None, None, None)]
    got = {r["name"]: r for r in pixels.measures(spark.createDataFrame(rows, "name string, width int, height int, channels int, pixels binary")).collect()}
    assert abs(got["a"]["fill_pct"] - 100 * 20 * 30 / 2400) < 1.5 and (got["a"]["bg_red"], got["a"]["transparent"]) == (255, False)
    assert got["b"]["fill_pct"] == 25.0 and got["b"]["transparent"] and got["c"]["error"] and got["d"]["error"]
    assert pixels.text_contrast(image.tobytes(), 60, 40, 3, (0, 0, 10, 10), (255, 255, 255)) == 1.0
    assert pixels.text_contrast(image.tobytes(), 60, 40, 3, (20, 10, 30, 20), (255, 255, 255)) > 15


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.nl/1", 0, 10, ["x", "y"]), ("https://a.nl/2", 2, 900, None), ("https://b.nl/", 1, 900, [])], "url string, h1_count int, word_count int, jsonld_types array<string>")
    assert reports.page_table(rows).columns == [*reports.PAGE_COLUMNS, *reports.MADE_COLUMNS] and len(reports.page_table(rows).columns) == 28
    assert reports.page_table(rows).where("url like '%/1'").first()["jsonld_types"] == "x, y"
    lists = facts.fix_lists(rows)
    made = json.loads(reports.fix_list("a.nl", lists))
    assert made["no_h1"] == ["https://a.nl/1"] and made["multi_h1"] == [{"url": "https://a.nl/2", "value": 2}] and made["low_word_count"][0]["value"] == 10
    shown = reports.html_report("<T>", {"Lists": lists.withColumn("x", F.lit("<b>"))})
    assert "&lt;T&gt;" in shown and "<b>" not in shown
    assert "Nothing found." in reports.markdown_report("T", {"None": lists.limit(0)})
    reports.write_text(spark, "é", f"file://{tmp_path}/r.md")
    assert (tmp_path / "r.md").read_text(encoding="utf-8") == "é"


def test_sources(spark):
    report = json.dumps({"loadingExperience": {"metrics": {"INTERACTION_TO_NEXT_PAINT": {"percentile": 180, "category": "AVERAGE"}}}, "lighthouseResult": {"audits": {"largest-contentful-paint": {"numericValue": 1234.6}}, "categories": {"seo": {"score": 0.91}}}})
    reports_ = spark.createDataFrame([("u", "mobile", report), ("v", "mobile", None)], "url string, strategy string, json string")
    got = {r["url"]: r for r in speed.fields(reports_).collect()}
    assert (got["u"]["inp_field"]["category"], got["u"]["lcp"], got["u"]["seo_score"], got["u"]["tbt"], got["v"]["lcp"]) == ("ni", 1235, 91, None, None)
    assert speed.vitals(reports_).where("url = 'u'").first()["inp"] == 180
    maps = spark.createDataFrame([("a", "<sitemapindex><sitemap><loc>s1</loc></sitemap></sitemapindex>"), ("a", "<urlset><loc>u</loc></urlset>")], "domain string, xml string")
    assert [r["url"] for r in tables.sitemap_index(maps).collect()] == ["s1"]
    import gzip

    files = spark.createDataFrame([("a", "x", bytearray(gzip.compress(b"<loc>u</loc>"))), ("a", "y", bytearray(b"<p>"))], "domain string, url string, content binary")
    assert {r["url"]: r["xml"] for r in tables.unpacked(files).collect()} == {"x": "<loc>u</loc>", "y": "<p>"}
    pages = spark.createDataFrame([("https://a.nl/x",), ("https://a.nl/y",)], "url string")
    assert tables.included(pages, "/x$").count() == 1 and tables.included(pages, "(").count() == 2 and tables.included(pages, None).count() == 2
    layer = spark.createDataFrame([("www.a.nl", "senior")], "domain string, profile string")
    assert {r["domain"]: r["profile"] for r in tables.profile(spark.createDataFrame([("https://a.nl",), ("b.nl",)], "domain string"), layer).collect()} == {"https://a.nl": "senior", "b.nl": "generic"}
