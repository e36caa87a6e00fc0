"""URL expressions. The five normalisers disagree on purpose: each belongs to one kind of comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URI pattern of RFC 3986, appendix B: scheme, authority, path, query, fragment.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def site(url: Column) -> Column:
    """Host without www., by which pages belong to one site."""
    return F.regexp_replace(host(url), r"^www\.", "")


def _with_query(base: Column, url: Column) -> Column:
    return F.concat(base, F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit("")))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, "/+$", "")


def crawl_key(url: Column) -> Column:
    """Link graph: no fragment, no query, no trailing slash, lower case."""
    return F.lower(_stripped(F.regexp_extract(url, r"^[^#?]*", 0)))


def visit_key(url: Column) -> Column:
    """Crawl frontier: no scheme, www., trailing slash or fragment; the query stays."""
    bare = F.regexp_extract(url, r"^[^#]*", 0)
    own = F.when(_stripped(path(bare)) == "", F.lit("/")).otherwise(_stripped(path(bare)))
    return _with_query(F.concat(site(bare), own), bare)


def canonical_key(url: Column) -> Column:
    """Canonical checks: scheme and host in lower case, no trailing slash but the root's."""
    u = F.trim(url)
    own = F.when(path(u) == "", F.lit("/")).when(F.length(path(u)) > 1, _stripped(path(u))).otherwise(path(u))
    return _with_query(F.concat(scheme(u), F.lit("://"), host(u), own), u)


def link_key(url: Column) -> Column:
    """Link optimiser: no fragment or www., index files are the root, https where there is no scheme."""
    u = F.regexp_extract(F.trim(url), r"^[^#]*", 0)
    root = path(u).isin("", "/", "/index.html", "/index.htm", "/index.php")
    own = F.when(root, F.lit("/")).when(F.length(path(u)) > 1, _stripped(path(u))).otherwise(path(u))
    of = F.when(scheme(u) == "", F.lit("https")).otherwise(scheme(u))
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(
        _with_query(F.concat(of, F.lit("://"), site(u), own), u)
    )


def health_key(url: Column) -> Column:
    """Sitemap health: no scheme or fragment, one trailing slash off, the query stays."""
    u = F.trim(url)
    own = F.when(path(u) == "", F.lit("/")).when(
        (path(u) != "/") & path(u).endswith("/"), F.regexp_replace(path(u), "/$", "")
    ).otherwise(path(u))
    return _with_query(F.concat(host(u), own), u)


def structure(url: Column) -> list[Column]:
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return [
        F.length(url).cast("int").alias("length"),
        F.size(F.filter(F.split(p, "/"), lambda x: x != "")).alias("depth"),
        (query(url) != "").alias("has_params"),
        F.concat(p, query(url)).rlike("[A-Z]").alias("has_uppercase"),
        F.contains(p, F.lit("_")).alias("has_underscore"),
        url.rlike(r"[^\x00-\x7F]").alias("has_non_ascii"),
        F.contains(p, F.lit("//")).alias("has_double_slash"),
        (F.length(url) > 115).alias("over_115_chars"),
        ((p != "/") & p.endswith("/")).alias("trailing_slash"),
    ]


def domain(text: Column) -> Column:
    """A domain as configured or crawled: no scheme, www., path or port, lower case."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^[^/:?#]*", 0), r"^www\.", "")


def page_type(url: Column, n_products: Column, has_product: Column) -> Column:
    """checkout before pdp before home before other."""
    checkout = r"(^|[/?&#=_-])(cart|checkout|winkel-?wagen|afreken(en)?|kassa)($|[/?&#=_./-])"
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "other")
        .when(F.lower(url).rlike(checkout), "checkout")
        .when((F.coalesce(n_products, F.lit(0)) > 0) | F.coalesce(has_product, F.lit(False)), "pdp")
        .when(path(url).isin("", "/"), "home")
        .otherwise("other")
    )


#: Patterns of the page tags.
TAGS = {
    "checkout": r"(?i)/(checkout|cart|winkelwagen|winkelmand|afrekenen|kassa|bestellen|bestelling)(/|$)",
    "contact": r"(?i)/(contact|klantenservice)(\.|/|$)",
    "guide": r"(?i)/(gids|blog|advies|kennisbank|uitleg|inspiratie|nieuws|handleiding|magazine)(/|-|$)",
    "plp": r"(?i)/(collectie|collections?|categorie|category|producten/?$|webshop|shop|assortiment|merk|merken|catalog|aanbod)(/|$)",
    "pdp": r"(?i)/(product|producten/[^/]+|p|products|model|item|artikel)(/|-|$)",
}


def page_tags(url: Column, has_product: Column) -> Column:
    p = path(url)
    checkout = p.rlike(TAGS["checkout"])
    pdp = (F.coalesce(has_product, F.lit(False)) | p.rlike(TAGS["pdp"])) & ~checkout
    tags = F.array_compact(
        F.array(
            F.when(p.isin("", "/"), F.lit("home")),
            F.when(checkout, F.lit("checkout")),
            F.when(url.rlike(TAGS["contact"]), F.lit("contact")),
            F.when(p.rlike(TAGS["guide"]), F.lit("guide")),
            F.when(p.rlike(TAGS["plp"]), F.lit("plp")),
            F.when(pdp, F.lit("pdp")),
        )
    )
    return F.when(F.size(tags) == 0, F.array(F.lit("other"))).otherwise(tags)


def redirect_loop(hops: Column, most: int = 12) -> Column:
    return (F.size(hops) > most) | (F.size(F.array_distinct(hops)) < F.size(hops))


def looks_like_html(content_type: Column, head: Column) -> Column:
    kind, start = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.substring(F.ltrim(head), 1, 512))
    named = kind.contains("text/html") | kind.contains("application/xhtml")
    return F.when(named, True).when((kind == "") | kind.contains("text/plain") | kind.contains("octet-stream"),
        start.contains("<html") | start.contains("<!doctype html") | start.contains("<head") | start.contains("<body")).otherwise(False)
