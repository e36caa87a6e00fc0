"""Queries over sites: silos, scores of internal linking, link plan, fix lists, page facts, scores and issues in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import audits, facts, graph, near_duplicates, pages, scoring, silos
from .catalog import ORACLES, query, table
from .graph_queries import trade
from .page_queries import _GRADE, _P, _PX, _Q, _SITE, _STRIP, _TITLE, ANCHORS, HEAD, WORDS
from .text_queries import _SETS

_BARE = lambda u: f"regexp_extract(trim({u}), '^[^#]*', 0)"
_OWNPATH = lambda u: f"case when {_P(_BARE(u), 3)} in ('', '/', '/index.html', '/index.htm', '/index.php') then '/' when length({_P(_BARE(u), 3)}) > 1 then {_STRIP(_P(_BARE(u), 3))} else {_P(_BARE(u), 3)} end"
_NODE = lambda u: f"((case when {_P(_BARE(u), 1)} = '' then 'https' else lower({_P(_BARE(u), 1)}) end) || '://' || {_SITE(_BARE(u))} || ({_OWNPATH(u)}) || {_Q(_BARE(u))})"
_SEGS = lambda u: f"list_filter(string_split({_P(u, 3)}, '/'), lambda x: x <> '')"
_STEM = lambda x: rf"regexp_replace({x}, '\.(html?|php|aspx)$', '')"
_HAS = lambda u, words: "(" + " or ".join(f"contains(lower({u}), '{w}')" for w in words) + ")"
_SYN = lambda x: f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in silos.SYNONYMS.items()) + f" else {x} end"


def _silo(u: str) -> str:
    base = f"lower(case when len({_SEGS(u)}) >= 2 then {_SEGS(u)}[1] when contains({_STEM(_SEGS(u) + '[1]')}, '-') then split_part({_STEM(_SEGS(u) + '[1]')}, '-', 1) else {_STEM(_SEGS(u) + '[1]')} end)"
    return f"case when len({_SEGS(u)}) = 0 then '(home)' else {_SYN(base)} end"


#: pg: pages with their node, site, silo and content flag; eg: links inside a site; nd: nodes; sl: silos; all once each.
_LINKED = f"""{HEAD}, pg as (select distinct url, {_NODE('url')} node, {_SITE('url')} site, title, h1, len({WORDS.format('text')}) wc from h),
pc as (select *, {_silo('node')} silo, {_HAS('url', silos.CONTENT)} or (greatest(wc, 1) >= {silos.CONTENT_WORDS} and not {_HAS('url', silos.SERVICE)} and not {_HAS('url', silos.COMMERCIAL)}) is_content from pg),
lk as (with {ANCHORS} select * from l),
eg as (select {_NODE('url')} src, {_NODE('target')} dst, target raw, anchor, {_SITE('url')} site from lk where regexp_matches(target, '^https?://') and {_SITE('target')} = {_SITE('url')}),
n0 as (select site, node from pg union select site, dst from eg),
nd as (select site, node, {_silo('node')} silo from n0),
sl as (select site, silo, count(*) members, bool_or(silo in ('model', 'merk', 'product', 'categorie') or {_HAS('node', silos.COMMERCIAL)}) commercial,
  arg_min(case when len({_SEGS('node')}) = 1 and (lower({_STEM(_SEGS('node') + '[1]')}) = silo or {_SYN('lower(' + _STEM(_SEGS('node') + '[1]') + ')')} = silo) then node end,
    case when len({_SEGS('node')}) = 1 and (lower({_STEM(_SEGS('node') + '[1]')}) = silo or {_SYN('lower(' + _STEM(_SEGS('node') + '[1]') + ')')} = silo) then (case when contains(node, '?') then '1' else '0' end) || lpad(length({_P('node', 3)})::varchar, 6, '0') || node end) hub
  from nd group by 1, 2)"""
_VAGUE = rf"""trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(coalesce(anchor, ''))), '[\s→›>»‹\-–—:.!?]+$', ''), '^[\s←«‹<\-–—]+', ''), '\s+', ' ', 'g'))"""
_IS_VAGUE = f"({_VAGUE} in ({T.quoted(silos.GENERIC_CONTEXT)}) or length({_VAGUE}) <= 2)"


def link_tables(spark, sf_dir):
    """The pages and their links inside a site, as the link operators take them."""
    raw = table(spark, sf_dir, "pages")
    own = pages.head(raw).withColumn("word_count", F.greatest(F.lit(1), F.size(F.expr(T.words("text")))).cast("int"))
    rows = pages.anchors(raw).where(F.col("target").rlike("^https?://") & (U.site(F.col("target")) == U.site(F.col("url"))))
    edges = rows.select(U.link_key(F.col("url")).alias("src"), U.link_key(F.col("target")).alias("dst"), F.col("target").alias("dst_raw"), "anchor", F.lit(False).alias("is_boiler"))
    return {"pages": own.select("url", "title", "h1", "word_count").distinct(), "edges": edges}


@query(f"with {_LINKED} select site, silo, members, commercial, hub from sl")
def silo_summary(spark, sf_dir):
    return silos.silos(silos.nodes(link_tables(spark, sf_dir)))


@query(f"""with {_LINKED},
a as (select site, round(100.0::double * (1 - avg({_IS_VAGUE}::int::double)), 1) anchor from eg where anchor is not null group by 1),
g as (select site, round(100.0::double * sum((exists (select 1 from eg where eg.src = pc.node and eg.site = pc.site and {_HAS('raw', silos.COMMERCIAL)}))::int) / count(*), 1) guide_link from pc where is_content group by 1),
k as (select pc.site, sum((exists (select 1 from eg where eg.src = pc.node and eg.dst = sl.hub))::int) / count(*)::double back from pc join sl on sl.site = pc.site and sl.silo = pc.silo
  where sl.hub is not null and sl.members >= 2 and pc.silo <> '(home)' and sl.hub <> pc.node group by 1),
es as (select eg.*, {_silo('dst')} dsilo from eg),
r as (select pc.site, sum((exists (select 1 from es join sl on sl.site = es.site and sl.silo = es.dsilo and sl.commercial where es.src = pc.node and es.site = pc.site))::int) / count(*)::double reach
  from pc where (is_content or silo = '(home)') and site in (select site from sl where commercial) group by 1),
si as (select coalesce(k.site, r.site) site, round(100.0::double * (coalesce(back, 0) + coalesce(reach, 0)) / ((back is not null)::int + (reach is not null)::int), 1) silo from k full join r on r.site = k.site),
b as (select site, 0.0::double breadcrumb from pg where len({_SEGS('url')}) >= 2 group by 1),
cr as (select distinct site, node from pg),
o as (select site, round(greatest(0, least(100, 100.0::double - 100.0::double * sum((node not in (select dst from eg where src <> dst) and len({_SEGS('node')}) > 0)::int) / count(*))), 1) orphan from cr group by 1),
x as (select s.site, anchor, guide_link, silo, breadcrumb, orphan from (select distinct site from pg) s left join a on a.site = s.site left join g on g.site = s.site left join si on si.site = s.site left join b on b.site = s.site left join o on o.site = s.site)
select *, round((coalesce(anchor, 0) * 0.22::double + coalesce(guide_link, 0) * 0.2::double + coalesce(silo, 0) * 0.18::double + 0 + coalesce(breadcrumb, 0) * 0.15::double + coalesce(orphan, 0) * 0.1::double) /
  nullif((anchor is not null)::int * 0.22::double + (guide_link is not null)::int * 0.2::double + (silo is not null)::int * 0.18::double + (breadcrumb is not null)::int * 0.15::double + (orphan is not null)::int * 0.1::double, 0), 1) score from x""")
def link_scores(spark, sf_dir):
    return silos.scores(link_tables(spark, sf_dir)).drop("pagerank")


_TOKENS = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^0-9a-zà-ÿ]+'), lambda w: length(w) >= 3 and w not in ({T.quoted(silos.STOP)})))"
_HUMAN = lambda x: rf"trim(regexp_replace(regexp_replace({_STEM(x)}, '[-_]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""with {_LINKED},
ib as (select dst node, count(distinct src) n from eg group by 1),
vg as (select distinct dst node from eg where anchor is not null and {_IS_VAGUE} and ({_HAS('raw', silos.COMMERCIAL)} or (select n from ib where ib.node = eg.dst) >= 2)),
cd as (select nd.site, nd.node, coalesce(ib.n, 0) inbound, nd.node in (select node from pg) known, nd.node in (select node from vg) generic, {_HAS('nd.node', silos.COMMERCIAL)} shop from nd left join ib on ib.node = nd.node),
w as (select *, round((case when shop then 2.0::double when known then 1.0::double else 0.0::double end) + generic::int + (case when inbound >= 1 then 0.6::double else 0.0::double end) + greatest(0, 2 - inbound) * 0.2::double, 3) importance
  from cd where shop or known or generic),
p as (select *, row_number() over (partition by site order by importance desc, inbound, {_P('node', 3)}, node) place from w),
t as (select * from p where place <= 20),
f as (select node, any_value(title) title from pg group by 1),
tw as (select t.site, t.node, unnest({_TOKENS(f"concat_ws(' ', f.title, {_HUMAN(f'''list_last(string_split({_P('t.node', 3)}, '/'))''')})")}) w from t left join f on f.node = t.node),
sw as (select site, node source, unnest({_TOKENS('title')}) w from pc where is_content or silo = '(home)'),
lf as (select distinct tw.node, sw.source from tw join sw on sw.site = tw.site and sw.w = tw.w where sw.source <> tw.node and not exists (select 1 from eg where eg.src = sw.source and eg.dst = tw.node)),
lr as (select *, row_number() over (partition by node order by source) k from lf)
select t.site, t.place::int place, t.node, t.importance, t.inbound, coalesce((select string_agg(source, ' ' order by source) from lr where lr.node = t.node and k <= 3), '') link_from from t""")
def link_plan(spark, sf_dir):
    """The targets of each site that need links most, and the pages to link from. Titles come from one page a node: the pages have one."""
    return silos.link_plan(link_tables(spark, sf_dir)).withColumn("link_from", F.array_join("link_from", " ")).drop("anchors")


@query()
def link_suggestions(spark, sf_dir):
    """Up to three anchor texts a page: its h1, cleaned title, URL."""
    own = link_tables(spark, sf_dir)["pages"]
    none = F.lit(None).cast("array<string>")
    return own.select("url", F.array_join(silos.suggested(F.col("url"), F.col("h1"), F.col("title"), none), " | ").alias("anchors"))


@query(rf"""with {HEAD}, b as (select *, regexp_replace(list_last(string_split({_P('url', 3)}, '/')), '[^A-Za-z0-9._-]+', '_', 'g')[1:60] base,
  substr(md5({_P('url', 3)} || {_Q('url')}), 1, 8) tag, regexp_replace(regexp_replace({_P('url', 3)}, '^/+|/+$', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g') slug from h),
r as (select page_id, strlen(html)::double n from pages)
select b.page_id, case when contains(base, '.') then case when regexp_extract(base, '^(.*)\.([^.]*)$', 1) = '' then 'img' else regexp_extract(base, '^(.*)\.([^.]*)$', 1) end || '_' || tag || '.' || regexp_extract(base, '^(.*)\.([^.]*)$', 2)
    else case when base = '' then 'img' else base end || '_' || tag || '.bin' end safe_name, case when slug = '' then 'home' else slug[1:80] end page_slug,
  round(100.0::double * strlen("text") / n, 1) text_html_ratio, lower(title) = lower(h1) and title <> '' title_equals_h1 from b join r on r.page_id = b.page_id""")
def page_facts(spark, sf_dir):
    raw = table(spark, sf_dir, "pages")
    own = pages.head(raw).join(raw.select("page_id", "html"), "page_id")
    u = F.col("url")
    return own.select(
        "page_id", facts.safe_name(u).alias("safe_name"), facts.page_slug(u).alias("page_slug"), facts.text_html_ratio(F.col("text"), F.col("html")).alias("text_html_ratio"),
        facts.title_equals_h1(F.col("title"), F.col("h1")).alias("title_equals_h1"),
    )


@query(f"""with {HEAD}, w as (select {_SITE('url')} site, url, h1_count, greatest(1, len({WORDS.format('text')}))::int wc from h),
f as (select site, url, 'no_h1' fault, h1_count "value" from w where h1_count = 0 union all select site, url, 'multi_h1', h1_count from w where h1_count > 1 union all select site, url, 'low_word_count', wc from w where wc < 300)
select *, (row_number() over (partition by site, fault order by "value", url))::int place from f""")
def fix_lists(spark, sf_dir):
    own = pages.head(table(spark, sf_dir, "pages")).withColumn("word_count", F.greatest(F.lit(1), F.size(F.expr(T.words("text")))).cast("int"))
    return facts.fix_lists(own.select("url", "h1_count", "word_count"))


@query(rf"""select {_SITE('url')} site, case when regexp_matches(lower(url), '(^|[/?&#=_-])(cart|checkout|winkel-?wagen|afreken(en)?|kassa)($|[/?&#=_./-])') then 'checkout' when {_P('url', 3)} in ('', '/') then 'home' else 'other' end "value", count(*) pages
from pages group by 1, 2""")
def page_type_histogram(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("url", U.page_type(F.col("url"), F.lit(0), F.lit(False)).alias("page_type"))
    return facts.histogram(own, "page_type")


@query()
def conversion_issues(spark, sf_dir):
    """Conversion checks that pages fail, by site."""
    from .audit_queries import _records

    return audits.conversion_issues(audits.conversion_checks(_records(spark, sf_dir)))


@query()
def site_audits(spark, sf_dir):
    """Scores of the audits that pages alone can feed, per site."""
    from .audit_queries import _records

    t = link_tables(spark, sf_dir) | {"records": _records(spark, sf_dir)}
    names = ("conversion", "links", "audience")
    found = [audits.REGISTRY[n].run(t).select("site", F.lit(n).alias("name"), F.col("score").cast("double").alias("score")) for n in names]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"with {_SETS} select a, b, round(shared / together::double, 3) similarity from j order by similarity desc, a, b limit 25")
def top_pairs(spark, sf_dir):
    sets = near_duplicates.shingle_sets(table(spark, sf_dir, "documents"), "doc_id", "text")
    return facts.top_pairs(near_duplicates.similar(sets, "doc_id"))


@query(f"""{ORACLES['pagerank_40'].rsplit('select node, round', 1)[0]}, z as (select node, round(r / (select sum(r) from p40), 5) pagerank from p40)
select node, pagerank, (row_number() over (order by pagerank desc, node))::int place from z order by pagerank desc, node limit 15""")
def pagerank_top(spark, sf_dir):
    return facts.top_ranks(graph.pagerank(*trade(spark, sf_dir)))


#: Scores of pages by what their HTML alone tells: in SQL, the inputs that it doesn't tell count as the rules have it.
_SCORED = f"""{HEAD},
w as (select *, {_PX('title', 20)} wide, len({WORDS.format('text')}) wc from h),
t as (select *, case when wc > 0 then wc else 1 end words from w),
i as (with {ANCHORS} select page_id, count(distinct target) n_int from l where regexp_matches(target, '^https?://') and {_SITE('target')} = {_SITE('url')} group by page_id),
{_TITLE.replace('from h)', 'from t)').replace('ratio from s)', 'title_ratio from s)')},
dc as (select *, case when trim(description) = '' then 1 else count(*) over (partition by {_SITE('url')}, lower(trim(description))) end dcopies from r),
x as (select dc.*, coalesce(i.n_int, 0) n_int, lower({_P('url', 1)}) = 'https' secure, length(trim(description)) dl, length(trim(title)) tl from dc left join i on i.page_id = dc.page_id),
q as (select *,
  round(title_ratio * 14, 2) e1,
  round(9 * (case when trim(description) = '' then 0.0::double else (0.5::double + 0.3::double * (case when dl between 70 and 160 then 1 when dl between 50 and 175 then 0.5 else 0 end)::double + 0.2::double * (dcopies <= 1)::int) / (0.5::double + 0.3::double + 0.2::double) end), 2) e2,
  round(9 * (0.5::double * (case when h1_count = 1 then 1.0::double when h1_count = 0 then 0.0::double else 0.3::double end) + 0.25::double + 0.25::double), 2) e3,
  round(12 * (0.4::double + 0.2::double * secure::int + 0.2::double * (canonical <> '')::int + 0.2::double), 2) e4,
  round(12 * (0.4::double * (words >= 200)::int + 0.3::double * (case when words >= 800 then 1.0::double when words >= 300 then 0.6::double + 0.4::double * (words - 300) / 500.0::double else words / 300.0::double end) + 0.15::double + 0.15::double * 0.7::double), 2) e5,
  round(11 * (0.35::double * (jsonld_count > 0)::int + 0.3::double + 0.2::double + 0.15::double * (case when jsonld_count > 0 then 0.5 else 0 end)::double), 2) e6,
  case when image_count > 0 then 8.0::double end e7,
  round(8 * (0.4::double + 0.25::double * least(1.0::double, n_int / 3.0::double) + 0.2::double + 0.15::double), 2) e8,
  round(9 * (0.2::double + 0.1::double * 0.8::double), 2) e9 from x),
y as (select *, round(e1 + e2 + e3 + e4 + e5 + e6 + coalesce(e7, 0) + e8 + e9, 2) points, 84.0::double + case when image_count > 0 then 8 else 0 end weight from q),
sc as (select *, round(100 * points / weight, 1) score from y),
iss as (
  select page_id, url, 'Critical' severity, 'title' category, 'title_missing' code, 'Title is missing' said from sc where trim(title) = ''
  union all select page_id, url, 'Medium', 'title', 'title_length', (case when tl < 30 then 'Title too short (' else 'Title cut off in results (' end) || tl || ' characters)' from sc where trim(title) <> '' and (tl < 30 or tl > 60)
  union all select page_id, url, 'High', 'title', 'title_duplicate', 'Title isn''t unique' from sc where trim(title) <> '' and copies > 1
  union all select page_id, url, 'High', 'meta_description', 'description_missing', 'Meta description is missing' from sc where trim(description) = ''
  union all select page_id, url, 'Medium', 'meta_description', 'description_length', 'Meta description length (' || dl || ' characters)' from sc where trim(description) <> '' and not dl between 70 and 160
  union all select page_id, url, 'Medium', 'meta_description', 'description_duplicate', 'Meta description isn''t unique' from sc where trim(description) <> '' and dcopies > 1
  union all select page_id, url, case when h1_count = 0 then 'Critical' else 'High' end, 'headings', 'h1_count', case when h1_count = 0 then 'No H1' else h1_count || ' H1 headings' end from sc where h1_count <> 1
  union all select page_id, url, 'Critical', 'indexability', 'not_https', 'Page isn''t served over HTTPS' from sc where not secure
  union all select page_id, url, 'Medium', 'indexability', 'canonical_missing', 'No canonical link' from sc where canonical = ''
  union all select page_id, url, 'High', 'content', 'thin', 'Thin content (' || words || ' words)' from sc where words < 200
  union all select page_id, url, 'Medium', 'structured_data', 'no_jsonld', 'No JSON-LD' from sc where jsonld_count = 0
  union all select page_id, url, 'Medium', 'links', 'links_few', 'Few internal links (' || n_int || ')' from sc where n_int < 3
  union all select page_id, url, 'Low', 'technical', 'security_headers', 'Security headers missing' from sc
  union all select page_id, url, 'Medium', 'technical', 'compression', 'No compression' from sc
  union all select page_id, url, 'Low', 'technical', 'caching', 'No cache headers' from sc)"""


@query(f"""with {_SCORED}, n as (select page_id, sum((severity = 'Critical')::int)::int c, sum((severity = 'High')::int)::int h, sum((severity = 'Medium')::int)::int m, sum((severity = 'Low')::int)::int l from iss group by 1)
select sc.page_id, score, {_GRADE('score')} grade, points, weight, n.c n_critical, n.h n_high, n.m n_medium, n.l n_low from sc join n on n.page_id = sc.page_id""")
def page_scores(spark, sf_dir):
    """Score, grade and issue counts of every page."""
    scored = scoring.score(scoring.from_pages(table(spark, sf_dir, "pages")))
    return scored.select("page_id", "score", "grade", "points", "weight", "n_critical", "n_high", "n_medium", "n_low")


@query(f"""with {_SCORED}, g as (select {_SITE('url')} site, count(score) pages, round(avg(score), 1) score from sc group by 1) select *, {_GRADE('score')} grade from g""")
def site_scores(spark, sf_dir):
    """Site score and grade per host."""
    found = scoring.site_scores(scoring.score(scoring.from_pages(table(spark, sf_dir, "pages"))))
    return found.select("site", "pages", "score", "grade")


@query(f"""with {_SCORED}, g as (select severity, said title, min(category) category, min(code) code, count(*) pages, min(url) first_url, list_sort(list(url))[1:12] urls from iss group by 1, 2)
select severity, title, category, code, pages, first_url, array_to_string(urls, ' ') urls from g order by list_position(['Critical', 'High', 'Medium', 'Low'], severity), pages desc, title limit 40""")
def top_issues(spark, sf_dir):
    """The 40 most frequent issues by severity."""
    found = scoring.top_issues(scoring.score(scoring.from_pages(table(spark, sf_dir, "pages"))))
    return found.withColumn("urls", F.array_join("urls", " "))
