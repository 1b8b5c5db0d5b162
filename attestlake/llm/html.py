"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; each block of the page is a line with its characters and tags. The ratio
of characters to tags per line is smoothed by a Gaussian, and a threshold of one standard deviation of the smoothed
ratios splits lines into content and the rest. The content lines choose the region: the article and main elements that
hold most of their characters, else the innermost section around all of them, whose own sections stay only if content
lines lie in them. Lists, tables and sections of the region go when they hold mostly links and few content lines, which
needs no class words. Everything else in the region stays, so short paragraphs, lists and tables of a chosen section do.

Taken out beforehand is what HTML itself names as navigation, forms, scripts and page headers and footers, and what is
boilerplate by role, class or id. In an article or main, headings and the ids of text blocks name their own text, as
may words such as alert or notice in a paragraph's class; words of adverts and sharing still count there. A header inside an article or a section belongs to it. Words such as sidebar in the
class of a wrapper (has-sidebar, or any element that holds the page's h1 or main and most of its content) don't count.

Null, empty and tag-only pages give the empty text. Open elements at the end of a cut-off page are closed there.
Repeated pages give their text again; a page of one very long line is one block. Time and memory are linear in the page,
however deep its elements lie: lines know their innermost element, sums go up the tree once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from attestlake.llm.common import without

SIGMA = 1.0
#: Elements that hold no main text.
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "menu", "button", "select", "textarea", "iframe", "svg", "canvas", "dialog", "object"}
SECTIONS = {"html", "body", "main", "article", "section", "div"}
CONTAINERS = SECTIONS | {"table", "ul", "ol", "dl", "blockquote", "td", "figure", "header"}
BLOCKS = CONTAINERS | SKIPPED | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "th", "pre", "hr", "figcaption", "caption", "address"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Start tags that end an open element of the first kind inside the nearest of the others.
IMPLIED = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dd", {"dl"}), "dd": ("dd", {"dl"}), "td": ("td", {"table", "tr"}), "tr": ("td", {"table"})}
#: Words in class, id or role of boilerplate.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "footer", "comment", "comments", "disqus", "share", "sharing", "social", "related", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "pagination", "pager", "contentinfo", "complementary", "toolbar"}
#: Those that the class of a text block in an article may mean of its own text; ids of text blocks there, and all of headings, name the text.
OF_TEXT = {"alert", "notice", "notices", "header", "search", "menu", "navigation", "banner"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXT = {"p", "pre", "blockquote", "li", "dt", "dd", "td", "th", "figcaption", "caption", "address"}
#: What goes when it holds links and few content lines.
LINK_BLOCKS = {"div", "section", "ul", "ol", "dl", "table"}
#: First words of classes that tell how a page is laid out, and those of an article's own header.
LAYOUT, OWN_HEADER = {"has", "with", "no", "without", "is", "js", "show", "hide"}, {"entry", "post", "article", "story", "content", "title", "section"}
INLINE = {"b", "i", "em", "strong", "span", "a", "br", "small", "sup", "sub", "u", "s", "font", "code", "abbr", "mark", "img", "input"}


def marked(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether class, id or role call the element boilerplate; inside: in an article or main, where text blocks tell of their own text."""
    if tag in INLINE or tag in ("html", "body", "main") or (inside and tag in HEADINGS):
        return False
    own = inside and tag in TEXT
    for k, v in attrs:
        if k not in ("class", "id", "role") or not v or (own and k == "id"):
            continue
        for name in v.lower().split():
            parts = re.split(r"[_-]+", name)
            if tag == "article":  # an article's classes hold words of all kinds
                parts = parts if len(parts) == 1 else []
            elif parts[0] in LAYOUT:
                continue
            elif parts[0] in OWN_HEADER and "header" in parts:
                parts = [x for x in parts if x != "header"]
            if not MARKS.isdisjoint(parts) and not (own and OF_TEXT.issuperset(MARKS.intersection(parts))):
                return True
    return False


class Element(NamedTuple):
    tag: str
    parent: int  # -1: none; parents come before their children
    skipped: bool  # by the element itself or one around it that HTML names
    mark: bool


class Line(NamedTuple):
    text: str
    tags: int
    at: int  # the innermost element, -1: none
    links: int  # characters in links


class Lines(HTMLParser):
    """The lines of one page, in order, and the tree of the elements around them. Linear in the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements: list[Element] = []
        self.stack: list[int] = []
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.heads: set[int] = set()  # innermost elements around an h1 or main
        self.held: list[str] = []
        self.tags, self.links, self.link = 0, 0, False

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.lines.append(Line(text, max(self.tags, 1), self.stack[-1] if self.stack else -1, self.links))
            self.tags = 0
        self.held.clear()
        self.links, self.link = 0, False

    def cut(self, i: int) -> None:
        """Closes all open elements from place i of the stack on."""
        for n in self.stack[i:]:
            self.open[self.elements[n].tag].pop()
        del self.stack[i:]

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, -1 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def pop(self, tag: str, within: set[str]) -> None:
        """Closes the innermost open element of this tag, unless one of `within` lies inside it."""
        i = self.last(tag)
        if i >= 0 and i > self.last(*within - {tag}):
            self.flush()
            self.cut(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.held.append(" ")
        if tag in BLOCKS:
            self.flush()
            if self.stack and self.elements[self.stack[-1]].tag == "p":
                self.cut(len(self.stack) - 1)
            if tag in IMPLIED:
                self.pop(*IMPLIED[tag])
        self.tags += 1
        self.link = self.link or tag == "a"
        if tag in ("h1", "main") and self.stack:
            self.heads.add(self.stack[-1])
        if tag in ("body", "article", "main"):
            while self.stack and self.elements[self.stack[-1]].tag in ("head", "title"):
                self.cut(len(self.stack) - 1)
        inside = self.last("article", "main") >= 0
        mark = marked(tag, attrs, inside)
        if tag not in VOID and tag not in INLINE and (mark or tag in CONTAINERS or tag in SKIPPED):
            top = self.stack[-1] if self.stack else -1
            page_header = tag == "header" and not inside and self.last("section") < 0
            skipped = (top >= 0 and self.elements[top].skipped) or tag in SKIPPED or page_header
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(len(self.elements))
            self.elements.append(Element(tag, top, skipped, mark))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag == "a":
            self.link = False
        self.tags += 1
        self.pop(tag, set())

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.held.append(data)
        if self.link:
            self.links += len(data.strip())


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    r = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - r), min(len(ratios), i + r + 1)
        ks = kernel[lo - i + r : hi - i + r]
        out.append(sum(k * x for k, x in zip(ks, ratios[lo:hi], strict=True)) / sum(ks))
    return out


def content_lines(lines: list[Line]) -> list[bool]:
    """Threshold clustering of the smoothed ratios."""
    s = smoothed([len(x.text) / x.tags for x in lines])
    mean = sum(s) / len(s)
    cut = math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))
    return [x >= cut for x in s]


def sums(elements: list[Element], lines: list[Line], links: bool = False) -> list[int]:
    """Characters (or those in links) of the lines in each element, by one walk up the tree; the page's own come last."""
    out = [0] * (len(elements) + 1)
    for x in lines:
        out[x.at] += x.links if links else len(x.text)
    for n in range(len(elements) - 1, -1, -1):
        out[elements[n].parent] += out[n]
    return out


def below(elements: list[Element], chosen: set[int]) -> list[bool]:
    """For each element whether it or one around it is chosen; the page itself comes last and isn't."""
    out = [False] * (len(elements) + 1)
    for n, e in enumerate(elements):
        out[n] = n in chosen or out[e.parent]
    return out


def named_regions(elements: list[Element], mass: list[int]) -> set[int]:
    """The outermost articles and mains with content lines; of an article instead that holds all of a main's."""
    top, best = [-1] * (len(elements) + 1), {}
    for n, e in enumerate(elements):
        top[n] = top[e.parent] if top[e.parent] >= 0 or e.tag not in ("article", "main") else n
        if top[n] >= 0 and mass[n] > 0:
            held = best.setdefault(top[n], n)
            if elements[held].tag != "article" and e.tag == "article" and mass[n] == mass[top[n]]:
                best[top[n]] = n
    return set(best.values())


def link_blocks(elements: list[Element], shown: list[Line], mass: list[int]) -> set[int]:
    """Lists, tables and sections with less than half of their text in content lines and at least two thirds of it in links."""
    text, links = sums(elements, shown), sums(elements, shown, links=True)
    return {n for n, e in enumerate(elements) if e.tag in LINK_BLOCKS and 2 * mass[n] < text[n] and 3 * links[n] >= 2 * text[n]}


def main_text(html: str | None) -> str:
    """The main text: kept blocks joined by a newline."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    tree = p.elements
    shown = [x for x in p.lines if x.at < 0 or not tree[x.at].skipped]
    if not shown:
        return ""
    chosen = {id(x) for x, yes in zip(p.lines, content_lines(p.lines), strict=True) if yes and (x.at < 0 or not tree[x.at].skipped)} or {id(x) for x in shown}
    mass = sums(tree, [x for x in shown if id(x) in chosen])
    holds_head = [n in p.heads for n in range(len(tree))] + [False]
    for n in range(len(tree) - 1, -1, -1):
        holds_head[tree[n].parent] |= holds_head[n]
    # Marked elements that hold the page are wrappers, whatever they are called.
    gone = below(tree, {n for n, e in enumerate(tree) if e.mark and not (holds_head[n] and 2 * mass[n] > mass[-1])})
    shown = [x for x in shown if not gone[x.at]]
    content = [x for x in shown if id(x) in chosen] or shown
    if not content:
        return ""
    mass = sums(tree, content)
    gone = below(tree, link_blocks(tree, shown, mass))
    shown = [x for x in shown if not gone[x.at]]
    inside = below(tree, named_regions(tree, mass))
    if 2 * sum(len(x.text) for x in content if inside[x.at]) >= mass[-1]:
        return "\n".join(x.text for x in shown if inside[x.at])
    region = max((n for n in range(len(tree)) if mass[n] == mass[-1]), default=-1)  # the innermost around all content
    while region >= 0 and tree[region].tag not in SECTIONS:
        region = tree[region].parent
    stays = [False] * len(tree) + [region < 0]
    for n, e in enumerate(tree):
        stays[n] = n == region or (mass[n] > 0 or e.tag not in SECTIONS if e.parent == region else stays[e.parent])
    return "\n".join(x.text for x in shown if stays[x.at])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars (code points), which replace columns so named. Map-only."""
    pages = without(pages, *{"text", "n_chars"} - {html})
    names = [n for n in pages.columns if n != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema.fields if f.name != html)
    return pages.select(*names, html).mapInArrow(run, f"{kinds}text string, n_chars long")
