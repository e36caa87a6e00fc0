"""Main text of web pages: flat text blocks, classified by a decision tree over a block and its neighbours.

A page is one run of tags and text. Block-level tags cut the text into blocks; each has its word count, its link
density, and the kind of the innermost enclosing element that tells one: article-like, or furniture such as
menus, headers, footers, side bars, adverts, notices, forms and comments, by tag name, role, class or id. A tree
grown on the labelled table below decides which blocks are the article's.

Defined cases: a null, empty or tagless html gives its plain text's blocks or an empty text; unclosed and
truncated tags end where an enclosing tag ends or the page does; repeated rows are extracted each; null ids stay
null; extra columns are ignored. No part of a page is cut off for its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from .common import only

#: Elements whose content is never text of the page.
RAW = "script|style|title|textarea|noscript|template|iframe|noframes|noembed|xmp"
#: Elements that end a block.
BLOCK = set(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt "
    "fieldset datalist figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul video".split()
)
#: Elements that are furniture, and those that hold the article.
FURNITURE = set("nav header footer aside form menu dialog button select datalist option fieldset svg search head".split())
ARTICLE = {"article", "main"}
CONTAINERS = FURNITURE - {"option"} | ARTICLE | set("div section ul ol table td details figure body html blockquote".split())
#: Words in class, id or role that mark furniture, and those that mark the article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notice|notification|alert"
    r"|side-?bar|menu\w*|nav\w*|breadcrumbs?|footer|site-?header|masthead|topbar|toolbar|comments?|comment-?list|replies"
    r"|disqus|social|share|sharing|related|recommend\w*|newsletter|subscri\w*|sign-?up|login|popup|modal|overlay|widget"
    r"|pagination|pager|search|copyright|legal|disclaimer|contentinfo|complementary|navigation)(?:$|[\s_-]|\d)",
    re.I,
)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|article-?body|post-?(?:body|content)|entry-?content|main-?content|story)(?:$|[\s_-])", re.I)
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?]?[a-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
#: Elements without blocks of their own, whose marks hold up to the next block.
LINES = set("p pre h1 h2 h3 h4 h5 h6 li dt dd address figcaption option".split())
#: Words that are as well the topic of an element whose class says that it is a post.
TOPIC = re.compile(r"(?:^|(?<=[\s_-]))(?:legal|disclaimer|search|social|promo\w*|notice|alert|menu\w*|recommend\w*)(?=$|[\s_-]|\d)", re.I)
POST = re.compile(r"(?:^|\s)(?:post|hentry|entry|article|story)(?:$|\s)", re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])hidden(?=$|[\s=/])", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: float  # share of the words inside links
    kind: int  # 1 in an article, -1 in furniture, 0 in neither
    heading: int


FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after", "kind", "heading")
#: The labelled table the tree is grown on: FEATURES, then 1 for the article's blocks.
TABLE = (
    # paragraphs, headings and one-word lines of articles, beside any neighbour
    *(
        (words, linked, *before, *after, 1, heading, 1)
        for words, linked, heading in ((1, 0.0, 0), (4, 0.0, 1), (9, 0.2, 0), (60, 0.3, 0))
        for before in ((0, 0.0), (2, 1.0), (6, 0.0), (70, 0.1))
        for after in ((0, 0.0), (3, 1.0), (5, 0.0), (80, 0.0))
    ),
    (120, 0.0, 80, 0.0, 95, 0.0, 1, 0, 1), (60, 0.05, 9, 0.0, 70, 0.0, 1, 0, 1), (14, 0.0, 60, 0.0, 40, 0.1, 1, 0, 1),
    (6, 0.0, 7, 0.9, 50, 0.0, 1, 1, 1), (9, 0.0, 12, 0.0, 80, 0.0, 1, 1, 1), (1, 0.0, 90, 0.0, 2, 0.0, 1, 0, 1),
    (2, 0.0, 1, 0.0, 70, 0.0, 1, 0, 1), (1, 0.0, 0, 0.0, 1, 1.0, 1, 0, 1), (3, 0.0, 40, 0.0, 11, 0.0, 1, 0, 1),
    (45, 0.3, 30, 0.0, 20, 0.0, 1, 0, 1), (25, 0.4, 30, 0.0, 60, 0.0, 1, 0, 1), (8, 0.0, 100, 0.0, 12, 0.2, 1, 0, 1),
    (200, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (12, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1), (5, 0.2, 50, 0.1, 50, 0.0, 1, 0, 1),
    # lists of links inside articles
    (3, 1.0, 4, 1.0, 3, 1.0, 1, 0, 0), (5, 1.0, 60, 0.0, 4, 1.0, 1, 0, 0), (2, 1.0, 3, 1.0, 8, 0.0, 1, 0, 0),
    (6, 0.9, 5, 1.0, 0, 0.0, 1, 0, 0), (4, 1.0, 3, 1.0, 70, 0.0, 1, 0, 0),
    # furniture, short and long
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, -1, 0, 0), (2, 1.0, 1, 1.0, 9, 0.0, -1, 0, 0),
    (9, 0.0, 1, 1.0, 8, 0.0, -1, 0, 0), (30, 0.0, 2, 1.0, 6, 0.0, -1, 0, 0), (90, 0.0, 70, 0.0, 60, 0.0, -1, 0, 0),
    (14, 0.0, 80, 0.0, 0, 0.0, -1, 0, 0), (8, 0.2, 50, 0.0, 0, 0.0, -1, 0, 0), (3, 0.0, 1, 1.0, 50, 0.0, -1, 1, 0),
    (40, 0.1, 90, 0.0, 35, 0.1, -1, 0, 0), (25, 0.0, 6, 0.0, 22, 0.0, -1, 0, 0), (150, 0.0, 0, 0.0, 5, 0.0, -1, 0, 0),
    # neither: text beside text is content, links and stray lines are not
    (80, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1), (40, 0.05, 9, 0.0, 60, 0.1, 0, 0, 1), (22, 0.1, 50, 0.0, 30, 0.0, 0, 0, 1),
    (18, 0.0, 45, 0.0, 16, 0.0, 0, 0, 1), (30, 0.0, 3, 1.0, 20, 0.0, 0, 0, 1), (7, 0.0, 3, 0.0, 60, 0.0, 0, 1, 1),
    (110, 0.2, 0, 0.0, 0, 0.0, 0, 0, 1), (8, 0.0, 70, 0.0, 80, 0.0, 0, 0, 1), (6, 0.0, 40, 0.0, 90, 0.0, 0, 0, 1),
    (3, 0.0, 55, 0.0, 45, 0.0, 0, 0, 1), (17, 0.0, 20, 0.0, 25, 0.0, 0, 0, 1), (5, 0.0, 2, 0.9, 45, 0.0, 0, 1, 1),
    # so is a paragraph at the start or the end of unmarked text, beside short blocks
    (13, 0.0, 40, 0.0, 2, 0.0, 0, 0, 1), (12, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1), (20, 0.0, 12, 0.0, 4, 0.0, 0, 0, 1),
    (11, 0.0, 35, 0.0, 5, 0.0, 0, 0, 1), (15, 0.0, 30, 0.0, 3, 1.0, 0, 0, 1), (16, 0.0, 14, 0.0, 8, 0.0, 0, 0, 1),
    (24, 0.0, 4, 1.0, 9, 0.0, 0, 0, 1), (13, 0.1, 25, 0.0, 1, 1.0, 0, 0, 1), (35, 0.0, 0, 0.0, 6, 0.0, 0, 0, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (5, 0.8, 2, 1.0, 40, 0.0, 0, 0, 0), (12, 0.6, 9, 0.7, 10, 0.6, 0, 0, 0),
    (30, 0.7, 8, 1.0, 12, 1.0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0), (6, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0),
    (3, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0), (7, 0.3, 4, 1.0, 3, 0.5, 0, 0, 0), (9, 0.5, 60, 0.0, 5, 1.0, 0, 0, 0),
    (4, 1.0, 80, 0.0, 0, 0.0, 0, 0, 0), (2, 0.0, 1, 1.0, 4, 1.0, 0, 1, 0), (50, 0.9, 20, 1.0, 30, 0.8, 0, 0, 0),
)


def grow(rows: tuple[tuple, ...], depth: int = 6):
    """A CART tree by Gini impurity: (feature, threshold, left, right), or the share of content at a leaf. Ties go to the earlier feature and the lower threshold."""
    share = sum(r[-1] for r in rows) / len(rows)
    if share in (0.0, 1.0) or not depth:
        return share
    gini = lambda part: 2 * (p := sum(r[-1] for r in part) / len(part)) * (1 - p) * len(part)
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            left, right = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            loss = gini(left) + gini(right)
            if best is None or loss < best[0] - 1e-12:
                best = (loss, f, cut, left, right)
    if best is None:
        return share
    _, f, cut, left, right = best
    return (f, cut, grow(tuple(left), depth - 1), grow(tuple(right), depth - 1))


TREE = grow(TABLE)


def is_content(features: tuple[float, ...], tree=TREE) -> bool:
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if features[f] <= cut else right
    return tree >= 0.5


def kind_of(name: str, attrs: str) -> int:
    """1, -1 or 0 as an element tells article, furniture or neither."""
    if name in ARTICLE:
        return 1
    if attrs and name not in ("body", "html"):
        if HIDDEN.search(attrs) or HIDDEN_ATTRIBUTE.search(QUOTED.sub('""', attrs)):
            return -1
        named = " ".join(a or b or c for a, b, c in NAMED.findall(attrs))
        if POST.search(named):
            named = TOPIC.sub("", named)
        if named and MARKED.search(named):
            return -1
        if named and CONTENT.search(named):
            return 1
    return -1 if name in FURNITURE else 0


def blocks(page: str) -> list[Block]:
    found: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    links: list[str] = []
    kind = heading = linked = at = 0

    def end() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                share = min(1.0, len(entities.unescape(" ".join(links)).split()) / words) if links else 0.0
                found.append(Block(text, words, share, kind, heading))
            parts.clear()
            links.clear()

    for m in TAG.finditer(page):
        if m.start() > at:
            parts.append(run := page[at : m.start()])
            if linked:
                links.append(run)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            linked = 0 if m["close"] else 1
        elif name == "br":
            parts.append("\n")
        elif name in BLOCK:
            end()
            if name in CONTAINERS:
                if m["close"]:
                    if any(x == name for x, _ in stack):
                        while stack.pop()[0] != name:
                            pass
                else:
                    if name == "body":
                        stack = [x for x in stack if x[0] != "head"]
                    if not m["attrs"].endswith("/"):
                        # a header inside an article is the article's own
                        own = kind_of(name, m["attrs"])
                        if name == "header" and own == -1 and kind == 1 and not MARKED.search(m["attrs"]):
                            own = 0
                        stack.append((name, own))
                kind = next((k for _, k in reversed(stack) if k), 0)
                linked = 0
            else:
                kind = next((k for _, k in reversed(stack) if k), 0)
                if name in LINES and not m["close"] and kind_of(name, m["attrs"]) == -1:
                    kind = -1
            heading = int(not m["close"] and len(name) == 2 and name[0] == "h" and name[1].isdigit())
    if at < len(page):
        parts.append(page[at:])
    end()
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    all_blocks = blocks(page)
    none = Block("", 0, 0.0, 0, 0)
    out = []
    for k, b in enumerate(all_blocks):
        before = all_blocks[k - 1] if k else none
        after = all_blocks[k + 1] if k + 1 < len(all_blocks) else none
        if is_content((b.words, b.linked, before.words, before.linked, after.words, after.linked, b.kind, b.heading)):
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                texts = [main_text(x) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
