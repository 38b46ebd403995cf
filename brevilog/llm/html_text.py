"""Main text of web pages by composite text density.

A page becomes a tree of elements. For every node

    density = C / T * log_b(C / LC * T / LT),   b = ln(C / (C - LC) * LC + LCb / Cb * C + e)

with C characters, T tags, LC characters inside links, LT link tags, and Cb, LCb of the body (a zero
denominator counts as 1): text with many links is pulled down, long plain text pulled up. The
node with the largest sum of its children's densities is the main node. The threshold is the smallest density on
the path from the body to it. Every block off that path that reaches the threshold, at any depth and of any name, and whose
text is not mostly links, gives the node with the largest sum below it (or itself) to the text too. If the main node lies in an article element, that element is the text.

Before that, elements whose name, role or class says that they are no text of the article (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, reader comments) are cut out.

The parser is the standard library's; unclosed elements end where HTML says they end. Work is linear in the page.

Cases: null or empty html, or html without text, gives an empty text; text outside any element counts as the body's;
a page cut off in a tag keeps what came before; rows that are repeated are each extracted; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img label br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("article aside blockquote body button div fieldset figure footer form header html main nav section table td th "
                  "ul ol dl details object".split())
CUT = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select option textarea "
                "input dialog head menu audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu toolbar".split())
MARKS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts "
                  "advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal "
                  "newsletter subscribe signup share sharing social related recommended comment comments disqus widget "
                  "pagination pager toolbar gdpr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Tree(HTMLParser):
    """Nodes in document order: tag, parent, marked (to be cut); and the run of texts and block borders."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.cut = ["body"], [-1], [False]
        self.open = [0]
        self.run: list[tuple[int, str | None]] = []

    def _pop_to(self, names: frozenset[str], stop: frozenset[str]) -> bool:
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[at]]
            if tag in names:
                del self.open[at:]
                return True
            if tag in stop:
                return False
        return False

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" or self.tag[self.open[-1]] == "head" and tag not in IN_HEAD and tag != "html":
            self._pop_to(frozenset(("head",)), frozenset())  # </head> may be left out
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            self._pop_to(frozenset(("p",)), SCOPE)
        if tag == "li":
            self._pop_to(frozenset(("li",)), frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            self._pop_to(frozenset(("dt", "dd")), frozenset(("dl",)))
        elif tag in ("td", "th"):
            self._pop_to(frozenset(("td", "th")), frozenset(("tr", "table")))
        elif tag == "tr":
            self._pop_to(frozenset(("tr",)), frozenset(("table",)))
        if tag not in INLINE:
            self.run.append((self.open[-1], None))
        elif tag == "br":
            self.run.append((self.open[-1], " "))
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.cut.append(tag in CUT or self._marked(tag, attrs))
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)

    def _marked(self, tag: str, attrs: list) -> bool:
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
            if name == "role" and value.lower() in ROLES:
                return True
            if name == "style" and "display:none" in value.lower().replace(" ", ""):
                return True
            if name in ("class", "id") and any(x.lower() in MARKS for x in _TOKEN.findall(value)):
                return True
        return tag == "header"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        if tag not in INLINE:
            self.run.append((self.open[-1], None))
        self._pop_to(frozenset((tag,)), frozenset() if tag in SCOPE else SCOPE)

    def handle_data(self, data: str) -> None:
        if data.strip() and self.tag[self.open[-1]] == "head":
            self._pop_to(frozenset(("head",)), frozenset())
        if data:
            self.run.append((self.open[-1], data))


def extract(html: str) -> str:
    """Main text of one page."""
    tree = _Tree()
    cut = html.rfind("<")
    if cut > html.rfind(">") and html[cut + 1 : cut + 2].isalpha() | (html[cut + 1 : cut + 2] in ("/", "!")):
        html = html[:cut]  # a tag that is cut off
    tree.feed(html)
    tree.close()
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    # A marked element that holds the headline or the article itself is only a wrapper.
    holds = [t == "h1" or t == "main" or t == "article" and not tree.cut[i] for i, t in enumerate(tag)]
    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i]
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[parent[i]] or tree.cut[i] and (tag[i] in CUT or not holds[i])
    # characters and tags, with and without links
    link = [False] * n
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        link[i] = link[parent[i]] or tag[i] == "a"
    for i, text in tree.run:
        if text and not gone[i]:
            size = len(" ".join(text.split()))
            chars[i] += size
            if link[i]:
                link_chars[i] += size
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            up = parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (tag[i] == "a")
    if not chars[0]:
        return ""
    body = link_chars[0] / chars[0]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c, t, lc, lt = chars[i], max(tags[i], 1), link_chars[i], max(link_tags[i], 1)
        if c and not gone[i]:
            base = math.log(c / max(c - lc, 1) * lc + body * c + math.e)
            density[i] = c / t * max(math.log(c / max(lc, 1) * t / lt) / math.log(base) if base > 1.0000001 else
                                     math.log(c / max(lc, 1) * t / lt) / 1e-7, 0.0)
    for i in range(1, n):
        total[parent[i]] += density[i]
    main = max(range(n), key=lambda i: (total[i], -i))
    if total[main] <= 0:
        main = 0
    roots = {main}
    path, at = [main], main
    while at:
        at = parent[at]
        path.append(at)
    article = [i for i in path if tag[i] in ("article", "main")]
    if article:
        roots = {article[0]}
    else:
        least = min(density[i] for i in path)
        on_path = set(path)
        best = list(range(n))  # the node with the largest sum in each subtree
        for i in range(n - 1, 0, -1):
            if total[best[i]] > total[best[parent[i]]]:
                best[parent[i]] = best[i]
        roots |= {best[i] for i in range(1, n) if i not in on_path and not gone[i] and chars[i]
                  and tag[i] not in INLINE and density[i] >= least and 2 * link_chars[i] < chars[i]}
        if main == 0:
            roots = {0}
    inside = [i in roots for i in range(n)]
    for i in range(1, n):
        inside[i] = inside[i] or inside[parent[i]]
    blocks, now = [], []
    for i, text in [*tree.run, (0, None)]:
        if text is None:
            if now and (block := " ".join("".join(now).split())):
                blocks.append(block)
            now = []
        elif inside[i] and not gone[i]:
            now.append(text)
    return "\n\n".join(blocks)


_OUT = "page_id long, url string, text string"
_OUT_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [extract(h.as_py() or "") for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url").cast(pa.string()),
                                                  pa.array(texts, pa.string())], schema=_OUT_ARROW)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, _OUT).withColumn("n_chars", F.length("text").cast("long"))
