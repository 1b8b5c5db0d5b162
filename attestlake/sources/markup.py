"""Elements of one HTML text, by a single pass over the parser's events."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Elements that are read, elements that are left out with all they hold, and elements without an end tag.
READ = frozenset("h1 h2 h3 p li table caption".split())
LEFT_OUT = frozenset("script style nav footer header".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag ends an open p; a start tag ends an open tag of its kinds up to the nearest of its containers.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select"}),
}


class _Walk(HTMLParser):
    """Open tags as a stack; an element is the range of text pieces between its start and its end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list | None]] = []
        self.counts: dict[str, int] = {}
        self.found: list[list] = []  # kind, first piece, piece after the last
        self.pieces: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        if tag in ENDS_P and self.counts.get("p"):
            self._end_within({"p"}, {"li", "td", "th", "table", "div", "article", "section", "body"})
        if tag in ENDS:
            self._end_within(*ENDS[tag])
        row = None
        if tag in READ and not self.hidden:
            row = [tag, len(self.pieces), None]
            self.found.append(row)
        self.open.append((tag, row))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.hidden += tag in LEFT_OUT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """<p/> is <p>, as browsers read it."""
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.counts.get(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.hidden and (text := data.split()):
            self.pieces.append(" ".join(text))

    def _pop(self) -> str:
        tag, row = self.open.pop()
        self.counts[tag] -= 1
        self.hidden -= tag in LEFT_OUT
        if row:
            row[2] = len(self.pieces)
        return tag

    def _end_within(self, tags: set[str], stop: set[str]) -> None:
        """Ends the outermost open tag of these kinds that lies within the nearest container, with all in it."""
        at = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                at = i
            elif self.open[i][0] in stop:
                break
        while at is not None and len(self.open) > at:
            self._pop()


#: An ampersand that begins no reference closed by a semicolon.
_BARE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)")


def elements(html: str, closed: bool = False) -> list[tuple[str, str, str | None]]:
    """(kind, value, section) of h1-h3, p, li, table and caption in document order.

    An element's value is all text within it, pieces joined by a space, so a table and the list items it holds both have the
    text. Character references are decoded, if closed only those that end with a semicolon, as XML has them, and not the
    likes of a bare &amp, which browsers read too; p, li and table parts end where HTML says that they do without an end tag.
    """
    walk = _Walk()
    walk.feed(_BARE.sub("&amp;", html) if closed else html)
    walk.close()
    while walk.open:
        walk._pop()
    out, section = [], None
    for kind, first, last in walk.found:
        if value := " ".join(walk.pieces[first:last]):
            section = value if kind[0] == "h" else section
            out.append((kind, value, section))
    return out
