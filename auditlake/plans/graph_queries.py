"""Queries over link graphs: the pages' own links, and a trade graph between nations that has structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import graph, pages
from .catalog import query, table
from .page_queries import _P, _STRIP, ANCHORS

_KEY = lambda u: f"lower({_STRIP(f'''regexp_extract({u}, '^[^#?]*', 0)''')})"
_EDGES = f"{ANCHORS}, e as (select page_id, {_KEY('url')} src, {_KEY('target')} dst from l where regexp_matches(target, '^https?://') and lower({_P('target', 2)}) = lower({_P('url', 2)}))"
_TRADE = """q as (select c_nationkey src, s_nationkey dst, sum(l_quantity) q from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2), t as (select src, dst from q where q > 1.2 * (select avg(q) from q))"""


def page_edges(spark, sf_dir):
    rows = pages.anchors(table(spark, sf_dir, "pages")).where(F.col("target").rlike("^https?://") & (U.host(F.col("target")) == U.host(F.col("url"))))
    return rows.select("page_id", U.crawl_key(F.col("url")).alias("src"), U.crawl_key(F.col("target")).alias("dst"))


def trade(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    edges = graph.trade_graph(spark, t("customer"), t("orders"), t("lineitem"), t("supplier"))
    return t("nation").select(F.col("n_nationkey").alias("node")), edges


@query(f"with {_EDGES}, i as (select distinct dst from e where src <> dst and dst <> '') select distinct {_KEY('url')} node from pages where {_KEY('url')} not in (select dst from i)")
def orphan_crawled(spark, sf_dir):
    nodes = table(spark, sf_dir, "pages").select(U.crawl_key(F.col("url")).alias("node"))
    return graph.orphans(nodes, page_edges(spark, sf_dir).select("src", "dst"))


@query(f"with {_EDGES}, m as (select distinct {_KEY('url')} node from pages union select src from e union select dst from e), i as (select distinct dst from e where src <> dst and dst <> '') select node from m where node not in (select dst from i)")
def orphan_sitemap(spark, sf_dir):
    """Every URL that pages or links name, in place of a sitemap, which the tables lack: those that no page's link reaches."""
    edges = page_edges(spark, sf_dir).select("src", "dst")
    nodes = table(spark, sf_dir, "pages").select(U.crawl_key(F.col("url")).alias("node"))
    sitemap = nodes.unionByName(edges.select(F.col("src").alias("node"))).unionByName(edges.select(F.col("dst").alias("node")))
    return graph.orphans(sitemap, edges)


@query(f"with {_EDGES}, n as (select src node from e union select dst from e), d as (select distinct src, dst from e where src <> dst) select node, coalesce((select count(*) from d where d.dst = node), 0)::bigint in_degree, coalesce((select count(*) from d where d.src = node), 0)::bigint out_degree from n")
def link_degrees(spark, sf_dir):
    edges = page_edges(spark, sf_dir).select("src", "dst")
    return graph.degrees(edges, edges.select(F.col("src").alias("node")).union(edges.select("dst")))


@query(f"with {_TRADE}, n as (select n_nationkey node from nation) select node, (select count(*) from t where dst = node)::bigint in_degree, (select count(*) from t where src = node)::bigint out_degree from n")
def trade_degrees(spark, sf_dir):
    nodes, edges = trade(spark, sf_dir)
    return graph.degrees(edges, nodes)


def _rounds(n: int) -> str:
    step = """p{b} as materialized (select x.node, x.o, 0.15::double / c.n + 0.85::double / c.n * coalesce((select sum(r) from p{a} where o = 0), 0) + 0.85::double * coalesce(g.gain, 0) r
  from p{a} x cross join c left join (select t.dst, sum(y.r / y.o) gain from p{a} y join t on t.src = y.node group by t.dst) g on g.dst = x.node)"""
    return ",\n".join(step.format(a=k, b=k + 1) for k in range(n))


@query(f"""with {_TRADE}, c as (select count(*)::double n from nation),
p0 as materialized (select n_nationkey node, (select count(*) from t where src = n_nationkey) o, 1.0::double / c.n r from nation, c),
{_rounds(40)}
select node, round(r / (select sum(r) from p40), 5) pagerank from p40""")
def pagerank_40(spark, sf_dir):
    return graph.pagerank(*trade(spark, sf_dir))


@query(f"""with recursive {_TRADE}, w as (select 0 node, 0 depth union select t.dst, w.depth + 1 from w join t on t.src = w.node where w.depth < 4)
select node::int node, min(depth)::int depth from w group by node""")
def crawl_depth(spark, sf_dir):
    """Depth at which a crawl from nation 0 along the trade graph sees each nation, up to 4."""
    nodes, edges = trade(spark, sf_dir)
    return graph.reached(graph.cut(edges), nodes.where("node = 0"), 4)
