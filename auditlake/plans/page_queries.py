"""Queries over `pages`: head fields, URLs, titles, links, scores, coverage, comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import coverage, links, pages, scoring
from .catalog import query, table

#: DuckDB: the parts of a URL, and the page's own fields.
URI = U.PARTS
_P = lambda u, n: f"regexp_extract({u}, '{URI}', {n})"
_CLEAN = r"regexp_replace(html, '(?is)<!--.*?-->|<(script|style|noscript|svg)\b.*?</(script|style|noscript|svg)\s*>', ' ', 'g')"
_UN = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_COL = lambda x: rf"trim(regexp_replace({x}, '[ \t-\r]+', ' ', 'g'))"
_SITE = lambda u: rf"regexp_replace(lower({_P(u, 2)}), '^www\.', '')"
_STRIP = lambda x: f"regexp_replace({x}, '/+$', '')"
_Q = lambda u: f"case when {_P(u, 4)} <> '' then '?' || {_P(u, 4)} else '' end"
HEAD = rf"""
c as (select page_id, url, html, {_CLEAN} clean from pages),
h as (
  select page_id, url, {_UN(_COL(r"regexp_extract(clean, '(?is)<title[^>]*>(.*?)</title>', 1)"))} title,
         regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) lang,
         lower(regexp_extract(html, '(?i)<meta[^>]*\bcharset="?([a-z0-9-]+)', 1)) charset,
         lower(regexp_extract(html, '(?i)<!doctype\s+([^>]*)>', 1)) = 'html' doctype_html5,
         {_UN(_COL(r"regexp_extract(clean, '(?is)<h1[^>]*>(.*?)</h1>', 1)"))} h1,
         len(regexp_extract_all(clean, '(?i)<h1\b'))::int h1_count,
         {_UN(r"""regexp_extract(clean, '(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1)""")} description,
         regexp_extract(clean, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) canonical,
         len(regexp_extract_all(html, '(?i)application/ld\+json'))::int jsonld_count,
         len(regexp_extract_all(clean, '(?i)<img\b'))::int image_count,
         {_COL(_UN(r"regexp_replace(regexp_replace(clean, '(?is)<title\b.*?</title>', ' ', 'g'), '<[^>]*>?', ' ', 'g')"))} text
  from c)"""
_AN = r"""(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>"""
ANCHORS = rf"""
c as (select page_id, url, {_CLEAN} clean from pages),
z as (select page_id, url, regexp_extract_all(clean, '{_AN}', 1) hr, regexp_extract_all(clean, '{_AN}', 2) inn from c),
y as (select page_id, url, unnest(range(0, len(hr))) pos, hr, inn from z),
a as (select page_id, url, pos::int pos, trim(hr[pos + 1]) href, {_COL(_UN("regexp_replace(inn[pos + 1], '<[^>]*>', ' ', 'g')"))} anchor from y),
l as (select *, case when href like '/%' and href not like '//%' then lower({_P('url', 1)}) || '://' || {_P('url', 2)} || href else href end target from a)"""
WORDS = r"regexp_extract_all(lower({}), '[a-zà-ÿ0-9][a-zà-ÿ0-9''-]+')"
_TITLE = f"""
s as (select *, case when trim(title) = '' then 1 else count(*) over (partition by {_SITE('url')}, lower(trim(title))) end copies from h),
r as (select *, length(title) n,
        case when title = '' then 0 else (0.45::double + 0.3::double * (case when length(title) between 30 and 60 then 1 when length(title) between 15 and 70 then 0.5 else 0 end)::double
          + 0.15::double * (case when copies > 1 then 0 else 1 end)::double + 0.1::double * (case when wide > 580 then 0 else 1 end)::double) / (0.45::double + 0.3::double + 0.15::double + 0.1::double) end ratio from s)"""


def _widths(x: str) -> str:
    terms = []
    for width, chars in T.WIDTHS.items():
        if width != 556:
            listed = "".join(("\\" + c) if c in "\\]^-[" else ("''" if c == "'" else c) for c in chars)
            terms.append(f"{width - 556} * (length({x}) - length(regexp_replace({x}, '[{listed}]', '', 'g')))")
    return f"(556 * length({x}) + " + " + ".join(terms) + ")"


_PX = lambda x, font: f"round_even({_widths(x)} / 1000.0::double * {font}, 0)::int"
_GRADE = lambda s: f"case when {s} >= 90 then 'A' when {s} >= 80 then 'B' when {s} >= 70 then 'C' when {s} >= 60 then 'D' when {s} >= 50 then 'E' else 'F' end"


@query(f"""with {HEAD},
w as (select *, {_PX('title', 20)} wide from h), {_TITLE.replace('from h)', 'from w)')},
g as (select {_SITE('url')} host, round(100 * avg(round(ratio, 3)), 1) title_pct, count(*) pages, sum((copies > 1 and title <> '')::int)::bigint duplicate_titles from r group by 1)
select *, {_GRADE('title_pct')} grade from g""")
def title_score_by_host(spark, sf_dir):
    """Title category per host: mean ratio, pages, duplicate titles, grade."""
    own = scoring.title_checks(pages.head(table(spark, sf_dir, "pages")))
    by = own.groupBy(U.site(F.col("url")).alias("host")).agg(
        F.round(100 * F.avg(F.round("ratio", 3)), 1).alias("title_pct"),
        F.count("*").alias("pages"),
        F.sum(((F.col("copies") > 1) & (F.col("title") != "")).cast("int")).alias("duplicate_titles"),
    )
    return by.withColumn("grade", scoring.grade(F.col("title_pct")))


@query(f"with {HEAD} select page_id, url, title, length(title)::int title_length, lang, charset, doctype_html5, h1, h1_count, description, canonical, jsonld_count, image_count, md5(text) text_md5 from h")
def page_head(spark, sf_dir):
    return pages.head(table(spark, sf_dir, "pages")).withColumn("text_md5", F.md5("text")).drop("text")


@query(rf"""with p as (select page_id, url, case when {_P('url', 3)} = '' then '/' else {_P('url', 3)} end p, {_P('url', 4)} q from pages)
select page_id, length(url)::int length, len(list_filter(string_split(p, '/'), lambda x: x <> ''))::int depth, q <> '' has_params,
  regexp_matches(p || q, '[A-Z]') has_uppercase, contains(p, '_') has_underscore, regexp_matches(url, '[^\x00-\x7F]') has_non_ascii,
  contains(p, '//') has_double_slash, length(url) > 115 over_115_chars, p <> '/' and p like '%/' trailing_slash from p""")
def url_structure(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *U.structure(F.col("url")))


_TRIM = "trim(url)"
_NOFRAG = "regexp_extract(trim(url), '^[^#]*', 0)"
_NOFRAG0 = "regexp_extract(url, '^[^#]*', 0)"
_OWN = lambda u: f"case when {_P(u, 3)} = '' then '/' when length({_P(u, 3)}) > 1 then {_STRIP(_P(u, 3))} else {_P(u, 3)} end"


@query(f"""select page_id, lower({_STRIP("regexp_extract(url, '^[^#?]*', 0)")}) crawl_key,
  {_SITE(_NOFRAG0)} || (case when {_STRIP(_P(_NOFRAG0, 3))} = '' then '/' else {_STRIP(_P(_NOFRAG0, 3))} end) || {_Q(_NOFRAG0)} visit_key,
  lower({_P(_TRIM, 1)}) || '://' || lower({_P(_TRIM, 2)}) || ({_OWN(_TRIM)}) || {_Q(_TRIM)} canonical_key,
  (case when {_P(_NOFRAG, 1)} = '' then 'https' else lower({_P(_NOFRAG, 1)}) end) || '://' || {_SITE(_NOFRAG)} ||
    (case when {_P(_NOFRAG, 3)} in ('', '/', '/index.html', '/index.htm', '/index.php') then '/' else {_OWN(_NOFRAG)} end) || {_Q(_NOFRAG)} link_key,
  lower({_P(_TRIM, 2)}) || (case when {_P(_TRIM, 3)} = '' then '/' when {_P(_TRIM, 3)} <> '/' and {_P(_TRIM, 3)} like '%/' then regexp_replace({_P(_TRIM, 3)}, '/$', '') else {_P(_TRIM, 3)} end) || {_Q(_TRIM)} health_key
from pages""")
def url_normalisers(spark, sf_dir):
    u = F.col("url")
    names = ("crawl_key", "visit_key", "canonical_key", "link_key", "health_key")
    return table(spark, sf_dir, "pages").select("page_id", *[getattr(U, n)(u).alias(n) for n in names])


@query(f"with {HEAD} select page_id, {_PX('title', 20)} title_px, {_PX('title', 20)} > 580 title_cut, {_PX('h1', 14)} h1_px, lower(title) = lower(h1) title_equals_h1, case when description = '' then 'ontbreekt' when length(description) < 70 then 'te_kort' when length(description) > 160 or {_PX('description', 14)} > 920 then 'te_lang' end description_issue from h")
def serp_pixel_width(spark, sf_dir):
    own = pages.head(table(spark, sf_dir, "pages"))
    return own.select(
        "page_id",
        F.expr(T.pixel_width("title", T.TITLE_FONT)).alias("title_px"),
        F.expr(f"{T.pixel_width('title', T.TITLE_FONT)} > {T.TITLE_LIMIT}").alias("title_cut"),
        F.expr(T.pixel_width("h1", T.DESCRIPTION_FONT)).alias("h1_px"),
        (F.lower("title") == F.lower("h1")).alias("title_equals_h1"),
        F.expr(T.description_issue("description")).alias("description_issue"),
    )


@query(f"with {HEAD} select {_SITE('url')} host, lower(trim(title)) title_key, count(*) pages, min(page_id) first_page from h where trim(title) <> '' group by 1, 2 having count(*) > 1")
def duplicate_titles(spark, sf_dir):
    own = pages.head(table(spark, sf_dir, "pages")).select("page_id", U.site(F.col("url")).alias("host"), F.lower(F.trim("title")).alias("title_key")).where("title_key <> ''")
    return own.groupBy("host", "title_key").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


@query(f"""with {ANCHORS}
select page_id, count(*) links, count(distinct target) targets, sum(({_SITE('target')} = {_SITE('url')})::int)::bigint internal,
  sum(({_SITE('target')} <> {_SITE('url')})::int)::bigint external, sum((anchor = '')::int)::bigint empty_anchors from l where regexp_matches(target, '^https?://') group by page_id""")
def outlinks(spark, sf_dir):
    return links.outlinks(pages.anchors(table(spark, sf_dir, "pages")))


@query(f"""with {ANCHORS} select lower(substr(anchor, 1, 80)) anchor, count(*) uses, count(distinct page_id) pages from l where anchor <> '' group by 1 order by uses desc, anchor limit 60""")
def anchors_top(spark, sf_dir):
    return links.top_anchors(pages.anchors(table(spark, sf_dir, "pages")), 60)


@query(f"""with {ANCHORS}, g as (select page_id, trim(regexp_replace(lower(anchor), '[^a-zà-ÿ0-9 ]', '', 'g')) k, anchor from l)
select page_id, count(*) anchors, sum((anchor = '')::int)::bigint empty, sum((k in ({T.quoted(links.GENERIC)}))::int)::bigint generic,
  sum((anchor = '' or k in ({T.quoted(links.GENERIC)}))::int)::bigint non_descriptive from g group by page_id""")
def anchor_quality(spark, sf_dir):
    return links.anchor_quality(pages.anchors(table(spark, sf_dir, "pages")))


@query(f"""with {HEAD},
w as (select *, {_PX('title', 20)} wide, len({WORDS.format('text')}) wc from h),
t as (select *, case when wc > 0 then wc else 1 end words from w),
i as ({{anchors}}),
{_TITLE.replace('from h)', 'from t)').replace('ratio from s)', 'title_ratio from s)')},
x as (select r.*, coalesce(i.n_int, 0) n_int,
  case when h1_count = 1 then 1.0::double when h1_count = 0 then 0.0::double else 0.3::double end h1r,
  case when lower({_P('url', 1)}) = 'https' then 1.0::double else 0.0::double end https,
  case when words >= 200 then 1.0::double else 0.0::double end thick,
  case when words >= 800 then 1.0::double when words >= 300 then 0.6::double + 0.4::double * (words - 300) / 500.0::double else words / 300.0::double end deep
  from r left join i on i.page_id = r.page_id)
select page_id, round(title_ratio, 3) title, round(case when description <> '' then 1 else 0 end, 3)::double meta_description,
  round((0.5::double * h1r + 0.25::double + 0.25::double), 3) headings,
  round(0.4::double + 0.2::double * https + 0.2::double * (case when canonical <> '' then 1 else 0 end) + 0.2::double, 3) indexability,
  round(0.4::double * thick + 0.3::double * deep + 0.15::double + 0.15::double * 0.7::double, 3) "content",
  round(0.4::double + 0.25::double * least(1.0::double, n_int / 3.0::double) + 0.2::double + 0.15::double, 3) links
from x""".replace("{anchors}", f"with {ANCHORS} select page_id, count(distinct target) n_int from l where regexp_matches(target, '^https?://') and {_SITE('target')} = {_SITE('url')} group by page_id"))
def page_category_ratios(spark, sf_dir):
    """Six of the categories, from what the pages' HTML alone tells."""
    raw = table(spark, sf_dir, "pages")
    scored = scoring.score(scoring.from_pages(raw))
    wanted = ("title", "meta_description", "headings", "indexability", "content", "links")
    by = scored.select("page_id", F.explode("breakdown").alias("b")).groupBy("page_id")
    return by.agg(*[F.max(F.when(F.col("b.key") == k, F.col("b.ratio"))).alias(k) for k in wanted])


@query(f"""with {HEAD}, b as (select {_SITE('url')} host, title <> '' title, description <> '' description, canonical <> '' canonical, lang <> '' lang, charset <> '' charset, h1_count > 0 h1, jsonld_count > 0 jsonld, image_count > 0 images, text <> '' "text" from h)
select coalesce(host, 'ALL') host, count(*) pages, round(100 * avg(title::int), 1) title_pct, round(100 * avg(description::int), 1) description_pct, round(100 * avg(canonical::int), 1) canonical_pct,
 round(100 * avg(lang::int), 1) lang_pct, round(100 * avg(charset::int), 1) charset_pct, round(100 * avg(h1::int), 1) h1_pct, round(100 * avg(jsonld::int), 1) jsonld_pct, round(100 * avg(images::int), 1) images_pct, round(100 * avg("text"::int), 1) text_pct
from b group by rollup(host)""")
def coverage_fill(spark, sf_dir):
    """Share of pages with a meaningful value per field, by host and overall."""
    own = pages.head(table(spark, sf_dir, "pages")).withColumn("host", U.site(F.col("url")))
    fields = {"title": "title", "description": "description", "canonical": "canonical", "lang": "lang", "charset": "charset", "h1": "h1_count", "jsonld": "jsonld_count", "images": "image_count", "text": "text"}
    return coverage.fill(own, fields, by="host")


_SUMMARY = f"""{HEAD}, w as (select *, greatest(1, len({WORDS.format('text')})) words, {_SITE('url')} host from h),
s as (select host, count(*) pages, bool_and(lower({_P('url', 1)}) = 'https') https, round(avg(words))::bigint avg_word_count, round(avg(length(title)))::bigint avg_title_len,
  round(100.0::double * sum((description <> '')::int) / count(*))::bigint pct_with_description, round(100.0::double * sum((canonical <> '')::int) / count(*))::bigint pct_with_canonical,
  round(100.0::double * sum((jsonld_count > 0)::int) / count(*))::bigint pct_with_jsonld, round(100.0::double * sum((h1_count = 1)::int) / count(*))::bigint pct_single_h1,
  count(distinct nullif(description, '')) unique_descriptions, sum(image_count)::bigint total_images, count(distinct title) unique_titles from w group by host)"""


@query(f"with {_SUMMARY} select * from s")
def site_summary(spark, sf_dir):
    return coverage.site_summary(pages.head(table(spark, sf_dir, "pages")))


@query(f"""with {_SUMMARY},
u as (select host, 'avg_word_count' signal, avg_word_count::double v from s union all select host, 'avg_title_len', avg_title_len from s union all select host, 'pct_with_description', pct_with_description from s
  union all select host, 'pct_with_canonical', pct_with_canonical from s union all select host, 'pct_with_jsonld', pct_with_jsonld from s union all select host, 'pct_single_h1', pct_single_h1 from s
  union all select host, 'unique_descriptions', unique_descriptions from s union all select host, 'unique_titles', unique_titles from s),
m as (select *, max(v) over (partition by signal) best, min(v) over (partition by signal) worst from u)
select host, sum((v = best and round(best, 3) <> round(worst, 3))::int)::bigint signals_won, rank() over (order by sum((v = best and round(best, 3) <> round(worst, 3))::int) desc)::int place from m group by host""")
def compare_sites(spark, sf_dir):
    """Signals won per site: the best value of a signal on which sites differ; ties all win."""
    from ..operators import compare

    summary = coverage.site_summary(pages.head(table(spark, sf_dir, "pages")))
    won = compare.wins(summary, "host", {k: True for k in ("avg_word_count", "avg_title_len", "pct_with_description", "pct_with_canonical", "pct_with_jsonld", "pct_single_h1", "unique_descriptions", "unique_titles")})
    return won.withColumn("place", F.rank().over(Window.orderBy(F.desc("signals_won"))))
