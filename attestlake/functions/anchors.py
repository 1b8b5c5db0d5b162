"""Typed values of a sentence, as native column expressions.

One alternation finds all figures in a single pass: the pattern that comes first in GRAMMAR takes the text, so a span has
one reading and nothing overlaps. What a pattern takes is then read by the number and date functions; a reading that
fails (1,2 million; 03/04/2020) leaves no anchor, and nothing else may claim its digits. Names, law and polarity have
passes of their own, since they may hold or cross figures.

An anchor is a struct of type, text, start, end (code points), canonical and subject. Null sentences have none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestlake.functions import text as X

ANCHOR = "struct<type:string,text:string,start:int,end:int,canonical:string,subject:string>"
FIGURES = ("money", "magnitude", "duration", "percent")
PARAMETRIC = (*FIGURES, "date", "governing_law", "polarity")

# The surfaces that anchors are written in.
SCALE_WORDS = ("thousand", "million", "billion")
SCALE_SUFFIXES = ("mm", "m", "b", "k")
MAGNITUDE_SUFFIXES = ("mld", "bln", "mln", "bn", "mn")
PERCENT_WORDS = ("%", "percent", "per cent", "bps", "basis points", "basis point")
DURATION_UNITS = ("year", "month", "week", "day")
SECTION_WORDS = ("Section", "Sec.", "Clause", "Article", "Schedule", "Exhibit")
REPORTERS = ("U.S.", "S. Ct.", "S.Ct.", "F.2d", "F.3d", "F.4th", "F. Supp.", "F. Supp. 2d", "F. Supp. 3d", "L. Ed. 2d", "N.E.2d", "N.W.2d", "P.2d", "P.3d", "A.2d", "A.3d", "So. 2d", "So. 3d")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
COMPANY_FORMS = ("Inc", "Corp", "LLC", "Ltd", "LLP", "PLC", "Company", "GmbH")
ROLES = ("Licensor", "Licensee", "Lessor", "Lessee", "Buyer", "Seller", "Borrower", "Lender", "Tenant", "Landlord", "Employer", "Employee", "Supplier", "Customer")
QUALIFIERS = ("exclusive", "transferable", "assignable", "revocable", "cancelable", "cancellable", "refundable", "binding", "sublicensable", "waivable")
POLAR_NOUNS = ("license", "licence", "right", "grant", "sublicense", "obligation", "offer", "agreement", "warranty", "commitment", "undertaking", "deposit", "fee", "payment", "arbitration", "mediation", "remedy")
NEGATORS = ("not", "no", "never", "nothing", "neither", "nor", "without", "except")
JURISDICTIONS = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana",
    "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina",
    "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia",
    "Wisconsin", "Wyoming", "England and Wales", "England", "Scotland", "Northern Ireland", "Ireland", "United Kingdom", "Canada", "Ontario", "Quebec", "British Columbia", "Alberta", "France", "Germany",
    "Italy", "Spain", "Netherlands", "Belgium", "Luxembourg", "Switzerland", "Sweden", "Japan", "Singapore", "Hong Kong", "India", "China", "Australia", "New South Wales", "Victoria", "Brazil", "Mexico",
    "South Korea", "United States",
)
#: Jurisdictions of which the first lies in the second.
CONTAINED = (
    ("england", "united kingdom"), ("england", "england and wales"), ("england and wales", "united kingdom"), ("scotland", "united kingdom"), ("ontario", "canada"), ("quebec", "canada"),
    ("british columbia", "canada"), ("alberta", "canada"), ("new south wales", "australia"), ("victoria", "australia"), ("hong kong", "china"), ("delaware", "united states"), ("new york", "united states"),
    ("california", "united states"), ("texas", "united states"),
)
#: Unit surface: dimension, factor to the dimension's base unit. Units that differ by region stand alone.
UNITS = {
    "mcg": ("mass", 1), "microgram": ("mass", 1), "mg": ("mass", 10**3), "milligram": ("mass", 10**3), "gram": ("mass", 10**6), "kg": ("mass", 10**9), "kilogram": ("mass", 10**9),
    "ml": ("volume", 1), "milliliter": ("volume", 1), "cl": ("volume", 10), "dl": ("volume", 100), "liter": ("volume", 10**3), "litre": ("volume", 10**3),
    "mm": ("distance", 1), "cm": ("distance", 10), "meter": ("distance", 10**3), "metre": ("distance", 10**3), "km": ("distance", 10**6), "kilometer": ("distance", 10**6), "kilometre": ("distance", 10**6),
    "wh": ("energy", 1), "kwh": ("energy", 10**3), "mwh": ("energy", 10**6), "gwh": ("energy", 10**9), "kw": ("power", 1), "mw": ("power", 10**3), "gw": ("power", 10**6),
    "mb": ("data", 1), "gb": ("data", 10**3), "tb": ("data", 10**6), "pb": ("data", 10**9), "iu": ("iu", 1), "ton": ("ton", 1), "tonne": ("tonne", 1), "oz": ("ounce", 1), "ounce": ("ounce", 1),
    "lb": ("pound", 1), "pound": ("pound", 1), "gallon": ("gallon", 1), "barrel": ("barrel", 1), "mile": ("mile", 1), "acre": ("acre", 1),
}


def _any(words: tuple[str, ...]) -> str:
    """An alternation, longer words first; a space is any white space."""
    return "(?:" + "|".join(w.replace(".", r"\.").replace(" ", r"\s+") for w in sorted(words, key=len, reverse=True)) + ")"


_RAW = r"\d[\d,]*+(?:\.\d++)?"
_NEW = r"(?<![\w.,$\-])"  # a number starts here
_WORD = _any((*X.ONES, *X.TENS, *X.BIG, "hundred"))
_CARDINAL = rf"(?:a|{_WORD})(?:[\s-]+{_WORD})*?"
#: Type and pattern, in order of precedence.
GRAMMAR = (
    ("citation", rf"{_NEW}\d{{1,4}}\s+{_any(REPORTERS)}\s+\d++\b"),
    ("slip_op", r"\bNo\.\s+\d{1,4}-\d{1,6}\b|\bslip\s+op\."),
    ("section", rf"(?:\b{_any(SECTION_WORDS)}\s+|§§?\s?)\d+(?:\.\d+)*+(?:\([a-z0-9]+\))?"),
    ("date", rf"\b\d{{4}}-\d\d-\d\d\b|\b{_any(MONTHS)}\s+\d{{1,2}},\s+\d{{4}}\b|\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b"),
    ("money", rf"\$\s?{_RAW}(?:\s*{_any(SCALE_WORDS)}(?![-\w])|{_any(SCALE_SUFFIXES)}(?![-\w]))?+"),
    ("money", rf"(?<![\w-]){_CARDINAL}\s+{_any(SCALE_WORDS)}\s+(?:dollars|usd)\b"),
    ("magnitude", rf"{_NEW}(?:(?:EUR|USD|GBP)\s?)?{_RAW}\s*{_any(SCALE_WORDS + MAGNITUDE_SUFFIXES)}\b"),
    ("percent", rf"{_NEW}{_RAW}\s*(?:{_any(PERCENT_WORDS[1:])}\b|%)"),
    ("duration", rf"(?:\(\d{{1,6}}\)|{_NEW}\d{{1,6}})\s+(?:calendar\s+)?{_any(DURATION_UNITS)}s?\b"),
    ("quantity", rf"{_NEW}{_RAW}\s?{_any(tuple(UNITS))}s?(?!\w)"),
    ("count", rf"{_NEW}(?:\d{{1,3}}(?:,\d{{3}})++|\d{{4,9}})(?![\w%]|[.,]\d)"),
    ("number", rf"(?<![\w$]){_RAW}"),  # digits that nothing may claim
)
FIGURE = "(?i)" + "|".join(f"(?:{p})" for _, p in GRAMMAR)
#: A sentence without any of these holds no anchor.
HINT = r"[0-9\"“§]|\b(?i:slip|govern|construed|law|" + "|".join(("dollars", "usd", *(rf"(?:non-?|ir)?{w}" for w in QUALIFIERS), *COMPANY_FORMS, *ROLES)) + ")"


def pieces(s: Column, pattern: str) -> Column:
    """The matches of pattern in s with their start, what stands before back to the last match, and what follows."""
    cut = F.split(F.regexp_replace(F.translate(s, "\u0001\u0002", "  "), F.lit(pattern), F.lit("\u0001$0\u0002")), "[\u0001\u0002]", -1)
    odd = lambda c: F.when(F.size(c) > 1, F.sequence(F.lit(1), F.size(c) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    piece = lambda c, i: F.struct(
        F.get(c, i).alias("text"), F.aggregate(F.slice(c, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)).alias("start"), F.get(c, i - 1).alias("before"), F.get(c, i + 1).alias("after"),
    )
    return X.let(cut, lambda c: F.transform(odd(c), lambda i: piece(c, i)))


def cardinal(words: Column) -> Column:
    """The value of a cardinal in words; null if they are none. Groups below a thousand end at a scale word."""
    low = F.filter(F.split(F.lower(F.trim(words)), r"[\s-]+"), lambda w: w != "")
    small = {**X.ONES, **X.TENS}
    table = F.create_map(*[F.lit(x) for w, v in small.items() for x in (w, v)])
    scale = F.create_map(*[F.lit(x) for w, v in X.BIG.items() for x in (w, v)])
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("last"), F.lit(10**15).cast("long").alias("cap"), F.lit(True).alias("ok"))

    def step(acc: Column, w: Column) -> Column:
        n, k = F.get(F.array(F.element_at(table, w)), F.lit(0)).cast("long"), F.element_at(scale, w).cast("long")
        # last: the least value that the group's last word leaves room for (100, 10 or 1)
        fits = F.when(n >= 20, (acc["last"] == 0) | (acc["last"] == 100)).when(n >= 10, (acc["last"] == 0) | (acc["last"] == 100)).otherwise((n > 0) & ((acc["last"] == 0) | (acc["last"] >= 10)))
        hundred, as_scale = (w == "hundred") & (acc["last"] == 1) & acc["group"].between(1, 9), k.isNotNull() & (acc["group"] > 0) & (k < acc["cap"])
        plain = n.isNotNull() & fits
        return F.struct(
            F.when(as_scale, acc["total"] + acc["group"] * k).otherwise(acc["total"]).alias("total"),
            F.when(as_scale, 0).when(hundred, acc["group"] * 100).when(plain, acc["group"] + n).otherwise(acc["group"]).cast("long").alias("group"),
            F.when(as_scale, 0).when(hundred, 100).when(plain & (n >= 20), 10).when(plain, 1).otherwise(acc["last"]).cast("long").alias("last"),
            F.when(as_scale, k).otherwise(acc["cap"]).alias("cap"), (acc["ok"] & (plain | hundred | as_scale)).alias("ok"),
        )

    out = F.aggregate(low, zero, step, lambda acc: F.when(acc["ok"] & (acc["total"] + acc["group"] > 0), acc["total"] + acc["group"]))
    return F.when((F.size(low) == 1) & (F.get(low, F.lit(0)) == "zero"), F.lit(0).cast("long")).when(F.size(low) > 0, out)


def _kind(x: Column) -> Column:
    """Which pattern of GRAMMAR takes the whole of x first."""
    out = F.lit("number")
    for kind, p in reversed(GRAMMAR[:-1]):
        out = F.when(x.rlike(f"(?i)^(?:{p})$"), kind).otherwise(out)
    return out


def _number(x: Column) -> Column:
    return X.grouped_number(F.regexp_extract(x, _RAW, 0))


def _times(x: Column, table: dict[str, int], pattern: str) -> Column:
    factor = F.create_map(*[F.lit(v) for k, n in table.items() for v in (k, n)])
    word = F.lower(F.regexp_extract(x, rf"(?i)({pattern})\W*$", 1))
    return F.coalesce(F.element_at(factor, word), F.lit(1)).cast("decimal(13,0)")


FACTORS = {"thousand": 10**3, "k": 10**3, "million": 10**6, "mm": 10**6, "m": 10**6, "mln": 10**6, "mn": 10**6, "billion": 10**9, "b": 10**9, "bn": 10**9, "bln": 10**9, "mld": 10**9}


def _canonical(kind: Column, x: Column) -> Column:
    """The value as text; null where the reading fails."""
    n = _number(x).cast("decimal(24,6)")
    words = F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+(dollars|usd)$", ""), r"^a\s+", "one ")
    dollars = F.when(x.contains("$"), F.bround(n * _times(x, FACTORS, _any(SCALE_WORDS + SCALE_SUFFIXES)) * 100, 0).cast("decimal(38,0)")).otherwise(cardinal(words).cast("decimal(30,0)") * 100)
    whole = n * _times(x, FACTORS, _any(SCALE_WORDS + MAGNITUDE_SUFFIXES))
    bps = F.when(F.lower(x).rlike(r"b(?:ps|asis\s+points?)$"), n).otherwise(n * 100)
    unit = F.lower(F.regexp_extract(x, r"(?i)([a-z]+?)s?$", 1))
    span = _number(x).cast("long") * F.when(unit == "year", 365).when(unit == "month", 30).when(unit == "week", 7).otherwise(1)
    factor = F.create_map(*[F.lit(v) for k, (_, f) in UNITS.items() for v in (k, f)])
    bulk = F.when(~F.regexp_extract(x, _RAW, 0).rlike(r"^\d{1,3}\.\d{3}$"), n * F.element_at(factor, unit).cast("decimal(13,0)"))
    digits = F.regexp_replace(x, ",", "").try_cast("long")
    count = F.when(x.contains(",") | ~digits.between(1800, 2199), digits.cast("string"))
    section = F.lower(F.regexp_replace(F.regexp_replace(x, r"(?i)^(?:[a-z.]+\s+|§§?\s?)", ""), r"\s+", ""))
    return (
        F.when(kind == "money", X.numeric_key(dollars)).when(kind == "magnitude", X.numeric_key(whole)).when(kind == "percent", X.numeric_key(bps)).when(kind == "duration", span.cast("string"))
        .when(kind == "date", X.unambiguous_date(F.regexp_replace(x, r"\s+", " "))).when(kind == "quantity", X.numeric_key(bulk)).when(kind == "count", count).when(kind == "section", section)
        .when(kind == "citation", F.lower(F.regexp_replace(x, r"\s+", " "))).when(kind == "slip_op", F.lower(F.regexp_replace(x, r"\s+", " ")))
    )


def _anchor(kind: Column, text: Column, start: Column, canonical: Column, subject: Column) -> Column:
    return F.struct(kind.alias("type"), text.alias("text"), start.alias("start"), (start + F.length(text)).alias("end"), canonical.alias("canonical"), subject.cast("string").alias("subject"))


def figures(s: Column | str) -> Column:
    """E1, E2, E4-E9, E14."""
    s = F.col(s) if isinstance(s, str) else s
    typed = F.transform(pieces(s, FIGURE), lambda p: F.struct(p.alias("p"), _kind(p["text"]).alias("kind")))
    dims = F.create_map(*[F.lit(v) for k, (d, _) in UNITS.items() for v in (k, d)])
    number_word = rf"(?i)\b(?:{'|'.join((*X.ONES, *X.TENS, *X.BIG, 'hundred'))})[\s,.-]*$"

    def made(v: Column) -> Column:
        p, kind = v["p"], v["kind"]
        unit = F.lower(F.regexp_extract(p["text"], r"(?i)([a-z]+?)s?$", 1))
        subject = (
            F.when(kind == "percent", F.nullif(F.regexp_extract(p["after"], r"^\s+([A-Z][A-Za-z]{2,})\b", 1), F.lit(""))).when(kind == "duration", unit)
            .when(kind == "quantity", F.element_at(dims, unit)).when(kind == "count", F.lit("count"))
        )
        # The top of a range, and an amount in words that a number word before it makes a longer one, are no readings.
        refused = ((kind == "percent") & p["before"].rlike(r"(?i)(?:^|[\d%])\s*(?:[-‐-―]|to|and|or|through)\s*$")) | ((kind == "money") & ~p["text"].contains("$") & p["before"].rlike(number_word))
        return _anchor(kind, p["text"], p["start"], F.when(~refused, _canonical(kind, p["text"])), subject)

    found = F.filter(F.transform(typed, made), lambda a: a["canonical"].isNotNull())
    return F.when(s.rlike(r"\d|(?i:dollars|usd|slip)"), found).otherwise(F.array().cast(f"array<{ANCHOR}>"))


def _named(s: Column, kind: str, pattern: str, canonical, keep=lambda p: F.lit(True)) -> Column:
    """Anchors of one pattern; canonical and keep are functions of the piece."""
    return F.transform(F.filter(pieces(s, pattern), keep), lambda p: _anchor(F.lit(kind), p["text"], p["start"], canonical(p), F.lit(None)))


def names(s: Column | str) -> Column:
    """E3 quotes (marks excluded), E10 governing law, E11 polarity, E12 parties."""
    s = F.col(s) if isinstance(s, str) else s
    quoted = F.transform(
        F.filter(pieces(s, "\"(?:[^\"\n]|\n(?!\\s*\n))+\"|“(?:[^”\n]|\n(?!\\s*\n))+”"), lambda p: p["text"].rlike(r"(?U)\w")),
        lambda p: _anchor(F.lit("quote"), F.substring(p["text"], F.lit(2), F.length(p["text"]) - 2), p["start"] + 1, F.lit(None).cast("string"), F.lit(None)),
    )
    place, of = _any(JURISDICTIONS), r"(?:(?:state|commonwealth|province)\s+of\s+)?(?:the\s+)?"
    # What stands before a place tells whether it is the law of a text; "the laws of X" counts after governed, construed, or before govern.
    ruled = r"(?i)(?:govern(?:ed|s)?|construed)\b[^.;:]{0,60}\blaws?\s+of\s+(?:the\s+)?" + of + "$|governed\\s+by\\s+(?:the\\s+)?$"
    law = _named(
        s, "governing_law", rf"(?i)\b{place}\b", lambda p: F.lower(F.regexp_replace(p["text"], r"\s+", " ")),
        lambda p: (p["before"].rlike(ruled) | (p["before"].rlike(rf"(?i)\blaws?\s+of\s+(?:the\s+)?{of}$") & p["after"].rlike(r"(?i)^[^.;:]{0,40}\bgoverns?\b")) | p["after"].rlike(r"(?i)^\s+law\s+(?:shall\s+|will\s+)?(?:governs?|appl)"))
        & ~p["before"].rlike(r"(?i)\b(?:north|south|east|west|federal|american|native|british|anglo)[\s-]+$"),
    )
    noun, word = rf"{_any(POLAR_NOUNS)}(?:s|ies)?", r"[A-Za-z][A-Za-z-]*"
    quality = rf"(?:non-?|ir)?{_any(QUALIFIERS)}"
    ahead = rf"^(?:[,\s]+{word}){{0,7}}?[,\s]+({noun})\b"
    behind = rf"\b({noun})\b[^.;:]{{0,30}}?\b(?:is|are|remains?|shall\s+be|will\s+be)\s+$"

    def head(p: Column) -> Column:
        return F.substring(s, F.lit(1), p["start"])

    def polar(p: Column) -> Column:
        low = F.regexp_replace(F.lower(p["text"]), "-", "")
        stem = F.regexp_replace(F.regexp_replace(low, "^(?:non|ir)", ""), "cancell", "cancel")
        near = F.lower(F.coalesce(F.nullif(F.regexp_extract(p["after"], f"(?i){ahead}", 1), F.lit("")), F.regexp_extract(head(p), f"(?i){behind}", 1)))
        single = F.regexp_replace(F.regexp_replace(F.regexp_replace(near, "ies$", "y"), "(?<!s)s$", ""), "licence", "license")
        return F.concat(stem, F.lit(":"), single, F.when(low.rlike("^(?:non|ir)"), "-").otherwise("+"))

    polarity = _named(
        s, "polarity", rf"(?i)(?<![\w-]){quality}(?![\w-])", polar,
        lambda p: (p["after"].rlike(f"(?i){ahead}") | head(p).rlike(f"(?i){behind}")) & ~head(p).rlike(rf"(?i)\b{_any(NEGATORS)}\b[^.;:]*$"),
    )
    party = _named(s, "party", rf"\b[A-Z][A-Za-z&]*(?:\s+[A-Z][A-Za-z&]*){{0,4}},?\s+{_any(COMPANY_FORMS)}\b\.?|\b{_any(ROLES)}\b", lambda p: F.lower(F.regexp_replace(p["text"], r"[,.]|\s+(?=\s)", "")))
    return F.concat(quoted, law, polarity, party)


#: A term in quotes that the text goes on to define.
DEFINED = "\\(?(?:(?:the|each,? an?|collectively,?(?: the)?)\\s+)?[\"“]([A-Z][A-Za-z ]{1,40}?)[\"”](?:\\)|\\s+(?:means|shall\\s+mean|has\\s+the\\s+meaning))"


def defined_terms(text: Column | str) -> Column:
    """The distinct terms that a text defines, in order."""
    return F.array_distinct(X.matches(text, DEFINED, 1))


def uses_of(s: Column, term: Column) -> Column:
    """Anchors of the occurrences of a term at word boundaries."""
    cut = F.split(s, F.concat(F.lit(r"(?<!\w)\Q"), term, F.lit(r"\E(?!\w)")), -1)
    at = lambda c: F.when(F.size(c) > 1, F.sequence(F.lit(1), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    start = lambda c, i: F.aggregate(F.slice(c, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)) + (i - 1) * F.length(term)
    return X.let(cut, lambda c: F.transform(at(c), lambda i: _anchor(F.lit("defined_term"), term, start(c, i), term, F.lit(None))))


def anchors(s: Column | str) -> Column:
    """All anchors of a sentence but terms, by start."""
    c = F.col(s) if isinstance(s, str) else s
    found = F.array_sort(F.concat(figures(c), names(c)), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], a["end"] - b["end"]).when(a["type"] < b["type"], -1).when(a["type"] > b["type"], 1).otherwise(0))
    return F.when(c.rlike(HINT), found).otherwise(F.array().cast(f"array<{ANCHOR}>"))
