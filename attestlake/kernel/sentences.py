"""Normal forms of quotes and what a quote has changed: small helpers on pairs of texts that have met already."""

from __future__ import annotations

import math
import re
import unicodedata
from difflib import SequenceMatcher

FOLD = str.maketrans({**dict.fromkeys("\u2018\u2019\u201a\u201b\u2032", "'"), **dict.fromkeys("\u201c\u201d\u201e\u201f\u2033", '"'), **dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-"), **dict.fromkeys("\u00ad\u200b\u200c\u200d\ufeff", "")})


def verbatim(text: str) -> str:
    """NFKC, one form of quotes, dashes and spaces; case stays."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(FOLD).split())


def match_form(text: str) -> tuple[str, list[int]]:
    """Lower-cased verbatim form, with the original offset of each of its characters."""
    out, at, space = [], [], True
    for i, c in enumerate(text):
        for f in unicodedata.normalize("NFKC", c).translate(FOLD).lower():
            if f.isspace():
                if not space:
                    out.append(" "), at.append(i)
                space = True
            else:
                out.append(f), at.append(i)
                space = False
    if out and out[-1] == " ":
        out.pop(), at.pop()
    return "".join(out), at


def find_verbatim(source: str, run: str) -> tuple[int, int] | None:
    """Span of run in source by match form, in the source's own offsets."""
    s, at = match_form(source)
    r, _ = match_form(run)
    i = s.find(r) if r else -1
    return None if i < 0 else (at[i], at[i + len(r) - 1] + 1)


def repair_quote(quote: str, source: str) -> str | None:
    """The source's own text for a quote: exact if found, else the longest common run if it covers 95 % and 40 characters."""
    got = find_verbatim(source, quote)
    if got:
        return source[got[0] : got[1]]
    s, at = match_form(source)
    q, _ = match_form(quote)
    least = max(math.ceil(0.95 * len(q)), min(40, len(q)))
    if not q:
        return None
    # Any common run of that length holds the middle of the quote, so the source is only searched for that.
    lo, hi = len(q) - least, least
    size, start = 0, 0
    i = s.find(q[lo:hi])
    while i >= 0:
        a, b = lo, hi
        while a > 0 and i - (lo - a) > 0 and q[a - 1] == s[i - (lo - a) - 1]:
            a -= 1
        while b < len(q) and i + b - lo < len(s) and q[b] == s[i + b - lo]:
            b += 1
        size, _, start = max((size, -len(q), start), (b - a, -a, i - (lo - a)), key=lambda x: x[:2])
        i = s.find(q[lo:hi], i + 1)
    return source[at[start] : at[start + size - 1] + 1] if size >= least else None


def quote_segments(quote: str, source: str) -> list[tuple[str, str]]:
    """(kind, text) tiles of a quote: verbatim in the source, altered, or neutral (marks and space only)."""
    a, b = quote.split(), source.split()
    out = []
    for op, i, j, _, _ in SequenceMatcher(None, [w.lower() for w in a], [w.lower() for w in b], autojunk=False).get_opcodes():
        if i < j:
            text = " ".join(a[i:j])
            out.append(("neutral" if not re.search(r"\w", text) else "verbatim" if op == "equal" else "altered", text))
    return out
