"""Reports of a run: the page table as CSV, content files, Markdown and HTML pages, fix lists, comparisons.

Tables of pages are written by the cluster. Reports are read by people: they hold the first rows of small results, and a
site each, so that their size doesn't grow with the crawl.
"""

from __future__ import annotations

import html as markup
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts
from . import sinks

#: The columns of the page table, those of the record and those made from it.
PAGE_COLUMNS = (
    "url", "status", "rendered_js", "response_ms", "size_kb", "title", "title_length", "meta_description",
    "meta_description_length", "h1_count", "word_count", "products_found", "image_count", "images_missing_alt",
    "external_links_count", "canonical", "meta_robots", "lang",
)
MADE_COLUMNS = (
    "h1", "top_keywords", "jsonld_types", "og_title", "internal_links_count", "indexability", "security_headers_count",
    "broken_links_count", "readability_flesch", "merchant_listing_ready",
)


def page_table(records: DataFrame) -> DataFrame:
    """The 28 columns; what the records lack is null. Lists are joined by ', ', headings by ' | '."""
    kinds = dict(records.dtypes)
    joined = lambda c, by: F.array_join(c, by) if kinds[c].startswith("array") else F.col(c)
    made = {"top_keywords": lambda c: F.array_join(F.slice(c, 1, 8), ", ") if kinds[c].startswith("array") else F.col(c), "jsonld_types": lambda c: joined(c, ", "), "h1": lambda c: joined(c, " | ")}
    return records.select(*[made.get(c, F.col)(c).cast("string").alias(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in (*PAGE_COLUMNS, *MADE_COLUMNS)])


def write_page_table(records: DataFrame, path: str) -> None:
    page_table(records).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_content(pages: DataFrame, path: str) -> None:
    """Texts by slug; a text per url, so that urls of one path don't overwrite each other."""
    pages.select("url", facts.page_slug(F.col("url")).alias("slug"), "text").write.mode("overwrite").partitionBy("slug").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file through the cluster's file system, whatever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def markdown_report(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """A heading and a table for each small result; an empty one says so."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        table = sinks.markdown(df, most)
        parts.append(f"## {name}\n\n" + (table if table.count("\n") > 1 else "Nothing found."))
    return "\n\n".join(parts) + "\n"


def html_report(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """The same as a page of its own, every value escaped."""
    cell = lambda v: markup.escape("" if v is None else str(v))
    out = [f"<!doctype html><html><head><meta charset=utf-8><title>{cell(title)}</title></head><body><h1>{cell(title)}</h1>"]
    for name, df in sections.items():
        rows = df.limit(most).collect()
        head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
        out.append(f"<section><h2>{cell(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></section>")
    return "\n".join([*out, "</body></html>"])


def fix_list(site: str, lists: DataFrame, invalid: DataFrame | None = None, most: int = 200) -> str:
    """A site's fix list as JSON: pages without an H1, with several, with few words, and schema types with what they miss."""
    rows = lists.where((F.col("site") == site) & (F.col("place") <= most)).orderBy("fault", "place").collect()
    found: dict[str, list] = {"no_h1": [], "multi_h1": [], "low_word_count": []}
    for r in rows:
        found[r["fault"]].append(r["url"] if r["fault"] == "no_h1" else {"url": r["url"], "value": r["value"]})
    types = [r.asDict() for r in invalid.orderBy("type").limit(most).collect()] if invalid is not None else []
    return json.dumps({"site": site, **found, "invalid_schemas": types}, ensure_ascii=False, indent=1)


def comparison(signals: DataFrame, wins: DataFrame, key: str) -> tuple[str, str]:
    """Sites side by side, signal by signal, with the signals each has won: as JSON and as Markdown."""
    sites = [r[key] for r in wins.orderBy(F.desc("signals_won"), key).limit(20).collect()]
    wide = signals.where(F.col(key).isin(*sites)).groupBy("signal").pivot(key, sites).agg(F.first("value")).orderBy("signal")
    rows = [r.asDict() for r in wide.collect()]
    won = {r[key]: r["signals_won"] for r in wins.where(F.col(key).isin(*sites)).collect()}
    return json.dumps({"sites": sites, "signals": rows, "signals_won": won}, ensure_ascii=False, indent=1), markdown_report("Comparison", {"Signals": wide, "Signals won": wins.orderBy(F.desc("signals_won"), key)})


def summary_of(spark: SparkSession, folder: str, domain: str) -> dict | None:
    """A domain's summary among those that a run left as JSON; none if it isn't there."""
    rows = spark.read.json(folder).where(F.col("domain") == domain).limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else None
