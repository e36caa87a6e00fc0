"""HTML pages parsed once into a nested record, by one Arrow map over the raw pages.

The standard library's tolerant parser feeds a flat list of elements; everything relational (counts, joins,
scores) is done on the record's columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

LINK = "pos: int, href: string, target: string, text: string, rel: array<string>, blank: boolean, has_image: boolean, in_boilerplate: boolean"
IMAGE = "pos: int, src: string, alt: string, width: string, height: string, loading: string, srcset: boolean, in_noscript: boolean"
HEADING = "pos: int, level: int, text: string"
FORM = "fields: int, search: boolean"
CTA = "pos: int, text: string, classes: string, in_header: boolean"
ITEM = "type: string, props: map<string,string>"
SCHEMA = (
    "title string, lang string, doctype string, charset string, metas map<string,string>, canonical string, "
    "hreflang array<struct<lang:string,href:string>>, rels array<struct<rel:string,href:string,type:string>>, "
    f"headings array<struct<{HEADING.replace(': ', ':')}>>, links array<struct<{LINK.replace(': ', ':')}>>, "
    f"images array<struct<{IMAGE.replace(': ', ':')}>>, forms array<struct<{FORM.replace(': ', ':')}>>, "
    f"ctas array<struct<{CTA.replace(': ', ':')}>>, jsonld array<string>, jsonld_bad int, "
    f"items array<struct<{ITEM.replace(': ', ':')}>>, rdfa boolean, times array<string>, resources array<string>, "
    "styles array<string>, classes array<string>, tables int, table_rows int, lists int, definitions int, nav_links int, "
    "text string, main_text string, raw_text string"
)
_SKIP = {"script", "style", "noscript", "svg", "template"}
_CHROME = {"nav", "header", "footer", "aside"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:nav|navbar|header|footer|menu|breadcrumbs?|sidebar|topbar|masthead)(?:$|[\s_-])", re.I)


def space(text: str) -> str:
    return " ".join(text.split())


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.stack, self.n = url, [], 0
        self.r = {k: [] for k in ("hreflang", "rels", "headings", "links", "images", "forms", "ctas", "jsonld", "items", "times", "resources", "styles", "classes")}
        self.r |= {"title": None, "lang": None, "doctype": None, "charset": None, "canonical": None, "metas": {}, "jsonld_bad": 0, "rdfa": False}
        self.r |= dict.fromkeys(("tables", "table_rows", "lists", "definitions", "nav_links"), 0)
        self.text, self.main, self.raw, self.open = [], [], [], []

    def within(self, names: set[str]) -> bool:
        return any(t in names for t, _ in self.stack)

    def boilerplate(self) -> bool:
        return any(t in _CHROME or _BOILERPLATE.search(c) for t, c in self.stack[-8:])

    def handle_decl(self, decl: str) -> None:
        m = re.match(r"doctype\s+(.*)", decl, re.I)
        if m and self.r["doctype"] is None:
            self.r["doctype"] = m[1].strip().lower()
        self.raw.append(decl)

    def handle_comment(self, data: str) -> None:
        self.raw.append(data)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        r, classes = self.r, f"{a.get('class', '')} {a.get('id', '')}".strip()
        if classes:
            r["classes"].append(classes)
        if a.get("style") and "url(" in a["style"]:
            r["styles"].append(a["style"])
        if "typeof" in a or "vocab" in a:
            r["rdfa"] = True
        if "itemtype" in a:
            r["items"].append({"type": a["itemtype"].rstrip("/").split("/")[-1], "props": {}})
        if "itemprop" in a and r["items"]:
            self.open.append(["prop", a["itemprop"], a.get("content", ""), [], len(r["items"]) - 1, tag])
        if tag == "html":
            r["lang"] = a.get("lang")
        elif tag == "meta":
            name = a.get("name") or a.get("property") or a.get("http-equiv") or ""
            if a.get("charset"):
                r["charset"] = a["charset"].lower()
            elif name:
                r["metas"].setdefault(name.lower(), a.get("content", ""))
                m = re.search(r"charset=([\w-]+)", a.get("content", ""), re.I)
                if name.lower() == "content-type" and m and not r["charset"]:
                    r["charset"] = m[1].lower()
        elif tag == "link":
            href, rels = self.absolute(a.get("href")), a.get("rel", "").lower()
            r["rels"].append({"rel": rels, "href": href, "type": a.get("type", "").lower()})
            if "canonical" in rels.split() and r["canonical"] is None:
                r["canonical"] = href
            if "alternate" in rels.split() and a.get("hreflang"):
                r["hreflang"].append({"lang": a["hreflang"], "href": href})
        elif tag == "a" and "href" in a:
            self.nav(a)
            self.open.append(["a", a, classes, [], self.boilerplate(), tag])
        elif tag == "img":
            r["images"].append(
                {"pos": len(r["images"]), "src": self.absolute(a.get("src") or a.get("data-src")), "alt": a.get("alt"), "width": a.get("width"), "height": a.get("height"), "loading": a.get("loading"), "srcset": "srcset" in a or self.within({"picture"}), "in_noscript": self.within({"noscript"})}
            )
            for o in self.open:
                if o[0] == "a":
                    o.append("image")
                    o[1].setdefault("alts", "")
                    o[1]["alts"] += " " + a.get("alt", "")
        elif re.fullmatch("h[1-6]", tag):
            self.open.append(["h", int(tag[1]), "", [], None, tag])
        elif tag == "title" and r["title"] is None and not self.within({"svg"}):
            self.open.append(["title", "", "", [], None, tag])
        elif tag in ("button",) or (tag == "input" and a.get("type", "").lower() in ("submit", "button")):
            self.n += 1
            if tag == "input":
                r["ctas"].append({"pos": self.n, "text": a.get("value", ""), "classes": classes, "in_header": self.within({"header", "nav"})})
            else:
                self.open.append(["cta", self.n, classes, [], self.within({"header", "nav"}), tag])
        elif tag == "form":
            r["forms"].append({"fields": 0, "search": a.get("role") == "search"})
        elif tag == "time" and a.get("datetime"):
            r["times"].append(a["datetime"])
        elif tag in ("ul", "ol"):
            r["lists"] += 1
        elif tag == "table":
            r["tables"] += 1
        elif tag == "tr":
            r["table_rows"] += 1
        elif tag == "dt":
            r["definitions"] += 1
        elif tag == "script" and "ld+json" in a.get("type", "").lower():
            self.open.append(["ld", "", "", [], None, tag])
        if tag in ("input", "select", "textarea") and r["forms"]:
            kind = a.get("type", "text").lower()
            if kind not in ("hidden", "submit", "button", "image", "reset"):
                r["forms"][-1]["fields"] += 1
            if kind == "search" or re.search(r"zoek|search", " ".join((a.get("name", ""), a.get("placeholder", ""), classes)), re.I):
                r["forms"][-1]["search"] = True
        for key in ("src", "data", "poster"):
            if a.get(key) and tag not in ("img",):
                r["resources"].append(a[key])
        if tag == "img" and a.get("src"):
            r["resources"].append(a["src"])
        if tag == "link" and a.get("href") and re.search(r"stylesheet|icon|preload", a.get("rel", ""), re.I):
            r["resources"].append(a["href"])
        if tag not in _VOID:
            self.stack.append((tag, classes))

    def nav(self, a: dict) -> None:
        self.n += 1
        if self.within({"nav"}):
            self.r["nav_links"] += 1

    def absolute(self, href: str | None) -> str | None:
        try:
            return urljoin(self.url, href.strip()) if href else None
        except ValueError:
            return href

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][5] == tag:
                self.ended(self.open.pop(k))
                break
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def ended(self, o: list) -> None:
        kind, text, r = o[0], "".join(o[3]), self.r
        if kind == "a":
            a, href = o[1], o[1]["href"].strip()
            target = self.absolute(href)
            label = space(text) or space(a.get("aria-label", "")) or space(a.get("alts", "")) or space(a.get("title", ""))
            try:
                target = urldefrag(target)[0] if target else None
            except ValueError:
                pass
            r["links"].append(
                {"pos": len(r["links"]), "href": href, "target": target, "text": label, "rel": a.get("rel", "").lower().split(), "blank": a.get("target", "").lower() == "_blank", "has_image": "image" in o[6:], "in_boilerplate": o[4]}
            )
            r["ctas"].append({"pos": self.n, "text": label, "classes": o[2], "in_header": self.within({"header", "nav"})})
        elif kind == "h":
            r["headings"].append({"pos": len(r["headings"]), "level": o[1], "text": space(text)[:200]})
        elif kind == "title":
            r["title"] = space(text)
        elif kind == "cta":
            r["ctas"].append({"pos": o[1], "text": space(text), "classes": o[2], "in_header": o[4]})
        elif kind == "prop":
            r["items"][o[4]]["props"].setdefault(o[1], o[2] or space(text))
        elif kind == "ld":
            for attempt in (text, re.sub(r"//\s*<!\[CDATA\[|//\s*\]\]>|<!\[CDATA\[|\]\]>|<!--|-->", "", text), text.replace("\r", " ").replace("\n", " ")):
                try:
                    r["jsonld"].append(json.dumps(json.loads(attempt.strip()), ensure_ascii=False))
                    return
                except ValueError:
                    continue
            r["jsonld_bad"] += 1

    def handle_data(self, data):
        for o in self.open:
            o[3].append(data)
        self.raw.append(data)
        if self.stack and self.stack[-1][0] == "style" and "url(" in data:
            self.r["styles"].append(data)
        if not self.within(_SKIP | {"title"}):
            self.text.append(data)
            if not self.within(_CHROME):
                self.main.append(data)

    def record(self) -> dict:
        while self.open:
            self.ended(self.open.pop())
        joined = {"text": space(" ".join(self.text)), "main_text": space(" ".join(self.main)).lower(), "raw_text": space(" ".join(self.raw)).lower()}
        return self.r | joined | {"classes": sorted(set(self.r["classes"]))}


def parse(html: str | None, url: str | None) -> dict | None:
    """The record of one page; null for a null html, what was read so far if the parser gives up."""
    if html is None:
        return None
    page = _Page(url or "")
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):
        pass
    return page.record()


def parsed(pages: DataFrame, rows: int = 256) -> DataFrame:
    """pages (url, html, ...) with the struct column `page` in place of html."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    ship(pages.sparkSession)
    record = _parse_datatype_string(SCHEMA)
    kept = [f for f in pages.schema.fields if f.name != "html"]
    out = StructType([*kept, StructField("page", record)])
    arrow = to_arrow_schema(StructType([StructField("page", record)])).field("page").type
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                some = batch.slice(low, rows)
                found = [parse(h, u) for h, u in zip(some.column("html").to_pylist(), some.column("url").to_pylist(), strict=True)]
                for r in found:
                    if r is not None:
                        r["metas"] = list(r["metas"].items())
                        r["items"] = [i | {"props": list(i["props"].items())} for i in r["items"]]
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), pa.array(found, arrow)], names=[*names, "page"])

    return pages.mapInArrow(run, out)
