"""Text, number and date functions as native column expressions.

Lengths and offsets are code points. Patterns are valid for Java; (?U) where Unicode classes matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't tell facts apart (function words, verbs of stating, scale words, currencies, units).
TOPIC_STOP_WORDS = """a an and are as at be been by for from in is it its no not notwithstanding of on or per shall should that the this to
under was were will with within would foregoing applicable total totals totaled totalling amount amounts pay payable paid states stated stating
million billion trillion thousand hundred mln bln mn bn mld dollar dollars euro euros usd eur gbp pound percent percentage
day days week weeks month months year years annual annually""".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matches(x: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(group))


# --- X: strings ----------------------------------------------------------------------------------------------------


def fold(x: Column | str) -> Column:
    """White space collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " ")))


def canonical(x: Column | str) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "")


def tokens(x: Column | str) -> Column:
    """Lower-cased runs of three or more ASCII letters."""
    return F.transform(matches(x, "[A-Za-z]{3,}"), F.lower)


def fact_tokens(x: Column | str) -> Column:
    """Distinct words of three or more letters without TOPIC_STOP_WORDS."""
    return F.array_except(F.filter(matches(F.lower(_c(x)), "[a-z]+"), lambda w: F.length(w) >= 3), F.array(*map(F.lit, TOPIC_STOP_WORDS)))  # set operations hash; both sides count once


def topic_tokens(x: Column | str, stop: list[str]) -> Column:
    """Words of four or more letters, a trailing s folded away before the stop list is applied."""
    w = F.transform(matches(F.lower(_c(x)), "[a-z]{4,}"), lambda t: F.regexp_replace(t, "s$", ""))
    return F.array_except(w, F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>"))


def edge_tokens(x: Column | str) -> Column:
    """Tokens between white space, without non-word characters at their edges."""
    w = F.transform(F.split(F.trim(_c(x)), r"(?U)\s+"), lambda t: F.regexp_replace(t, r"(?U)^\W+|\W+$", ""))
    return F.filter(w, lambda t: t != "")


def simple_sentences(x: Column | str) -> Column:
    """Split after . ! ? and at line breaks; bullets end a sentence."""
    flat = F.regexp_replace(_c(x), "[\u25aa\u2022\uf0b7]", ". ")
    parts = F.transform(F.split(flat, r"(?<=[.!?])\s+|\n+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


#: Abbreviations whose full stop doesn't end a sentence.
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|No|Nos|Art|Arts|Sec|Secs|Fig|Figs|Ch|Para|Paras|Cl|pp|vs|v|al|Inc|Corp|Ltd|Co|cf|e\\.g|i\\.e|ed|eds|Rev|vol|approx|dept|est|U\\.S|U\\.K|Ct|Supp|Ed"
SPACE = " \t\n\r\f\x0b"
#: The end of a sentence with the space after it: stops before an opening of the next one, or line breaks.
SENTENCE_END = (
    rf"(?=[.!?])(?<!(?i:\b(?:{ABBREVIATIONS})))(?<!\b[A-Z])(?<!^\s{{0,4}}\d{{1,3}})[.!?]+[\"'\u201d\u2019)\]]*(?:\s+(?=[\"'\u201c\u2018(\[]*[A-Z0-9\u00c0-\u00dc\u00a7])|\s*\n\s*|\s*$)|\s*\n\s*"
)


def let(x: Column, f) -> Column:
    """f(x) with x computed once: what a lambda reads from outside is computed again for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(a: Column) -> Column:
    """The running sums of an array of whole numbers, by blocks of about the square root of its size: each step copies a block only."""

    def within(x: Column, base: Column) -> Column:
        zero = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, zero, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v)).alias("out")), lambda acc: acc["out"])

    def by_blocks(a: Column) -> Column:
        b = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / b).cast("int")), lambda k: F.slice(a, k * b + 1, b))
        heads = lambda x: F.concat(F.array(F.lit(0)), within(F.transform(x, lambda v: F.aggregate(v, F.lit(0), lambda p, q: p + q)), F.lit(0)))
        return let(blocks, lambda x: F.flatten(F.zip_with(x, F.slice(heads(x), F.lit(1), F.size(x)), within)))

    return let(a, by_blocks)


def sentence_spans(x: Column | str) -> Column:
    """Array of start, sentence. A line break is a boundary; abbreviations, initials and a line's own number are not."""
    cut = F.split(F.regexp_replace(F.translate(F.coalesce(_c(x), F.lit("")), "\u0001", " "), F.lit(SENTENCE_END), F.lit("$0\u0001")), "\u0001", -1)

    def span(p: Column, end: Column) -> Column:
        return F.struct((end - F.length(F.ltrim(p, F.lit(SPACE)))).alias("start"), F.btrim(p, F.lit(SPACE)).alias("sentence"))

    spans = let(cut, lambda c: F.zip_with(c, running(F.transform(c, lambda p: F.length(p))), span))
    return F.filter(spans, lambda s: s["sentence"] != "")


#: A sentence that has come to its end, and a line that stands alone: numbered, marked, or a few capitalized words.
ENDED = rf"(?<!(?i:\b(?:{ABBREVIATIONS})))(?<!\b[A-Z])[.!?:]+[\"'\u201d\u2019)\]]*$"
ALONE = r"^(?:#+\s|[-*\u2022]\s|\(?[a-z0-9]{1,3}[.)]\s|(?:(?:Section|Article|Clause|Schedule|Exhibit)\s+)?\d+(?:\.\d+)*\.?\s+[A-Z])|^[A-Z0-9][\w'-]*(?:\s+(?:[A-Z0-9][\w'-]*|of|the|and|for|to|in|on)){0,11}$"


def logical_sentences(x: Column | str) -> Column:
    """Array of group, start, sentence. A line that wraps, having neither ended nor standing alone, shares its group with the next one.

    A blank line, a heading and a list item always part groups. Starts are those of sentence_spans: they slice the text.
    """
    text = F.coalesce(_c(x), F.lit(""))

    def grouped(s: Column) -> Column:
        def opens(one: Column, i: Column) -> Column:
            before = F.get(s, i - 1)
            end = before["start"] + F.length(before["sentence"])
            gap = F.substring(text, end + 1, one["start"] - end)
            wraps = F.contains(gap, F.lit("\n")) & ~gap.rlike(r"\n\s*\n") & ~before["sentence"].rlike(ENDED) & ~before["sentence"].rlike(ALONE) & ~one["sentence"].rlike(ALONE)
            return F.when((i > 0) & F.coalesce(wraps, F.lit(False)), 0).otherwise(1)

        return F.zip_with(s, running(F.transform(s, opens)), lambda one, g: F.struct((g - 1).alias("group"), one["start"].alias("start"), one["sentence"].alias("sentence")))

    return let(sentence_spans(x), grouped)


def strip_footnotes(x: Column | str) -> Column:
    """A number of one or two digits that is glued to the end of a word or closing mark goes."""
    return F.regexp_replace(_c(x), r"(?<=[a-z.,;:!?)\u201d\"])\d{1,2}(?=\s|$)", "")


def contains_folded(source: Column | str, run: Column | str) -> Column:
    """The run occurs in the source, white space and case folded; an empty run always does."""
    r = fold(run)
    return (r == "") | F.contains(fold(source), r)


def quoted_spans(x: Column | str) -> Column:
    """Texts between a pair of straight or curly double quotes, not over a blank line."""
    one = matches(x, "\"((?:[^\"\n]|\n(?!\\s*\n))+)\"|\u201c((?:[^\u201d\n]|\n(?!\\s*\n))+)\u201d", 0)
    return F.transform(one, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def quote_phrases(x: Column | str) -> Column:
    """The parts of a quote between declared edits: bracketed words and dots of omission."""
    parts = F.split(_c(x), r"\[[^\]]*\]|\.{3,}|\u2026|(?:\. ){2,}\.")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^[\s,;:.]+|[\s,;:.]+$", "")), lambda p: p.rlike(r"(?U)\w"))


def first_letter_variants(x: Column | str) -> Column:
    """The phrase with its first letter in either case."""
    c, rest = F.substring(_c(x), 1, 1), F.substr(_c(x), F.lit(2))
    return F.array_distinct(F.array(_c(x), F.concat(F.upper(c), rest), F.concat(F.lower(c), rest)))


def figure_skeleton(x: Column | str) -> Column:
    """Figures become #, then all that is neither letter nor # one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[$\u20ac\u00a3]?[0-9][0-9,]*(?:\.[0-9]+)?%?", "#"), "[^a-z#]+", " "))


def clean_label(x: Column | str) -> Column:
    """Camel case and letter-digit joints split, underscores and dashes opened, adjacent repeats dropped."""
    s = F.regexp_replace(_c(x), "([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(F.regexp_replace(s, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")
    words = F.filter(F.split(F.trim(F.regexp_replace(s, r"[_\-\s]+", " ")), " "), lambda w: w != "")
    start = F.array().cast("array<string>")
    kept = F.aggregate(words, start, lambda a, w: F.when((F.size(a) > 0) & (F.lower(F.element_at(a, F.when(F.size(a) > 0, -1).otherwise(1))) == F.lower(w)), a).otherwise(F.concat(a, F.array(w))))
    return F.array_join(kept, " ")


def or_query(x: Column | str) -> Column:
    """Distinct word tokens in their order, quoted, joined by OR."""
    return F.array_join(F.transform(F.array_distinct(matches(x, r"[A-Za-z0-9_]+")), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def strip_cloze(x: Column | str) -> Column:
    """{{cN::text}} and {{cN::text::hint}} become text."""
    return F.regexp_replace(_c(x), r"\{\{c[0-9]+::(.*?)(?:::[^}]*)?\}\}", "$1")


def escape_markup(x: Column | str) -> Column:
    """& < > as references."""
    return F.replace(F.replace(F.replace(_c(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cut_at_word(x: Column | str, n: int) -> Column:
    """At most n code points, ending at a word boundary; shorter texts stay."""
    s = _c(x)
    return F.when(F.length(s) <= n, s).otherwise(F.rtrim(F.regexp_extract(F.substring(s, 1, n), r"(?s)^(.*)\s", 1)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two token arrays; 0 for two empty ones."""
    u = F.size(F.array_union(_c(a), _c(b)))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / u)


# --- N: numbers ----------------------------------------------------------------------------------------------------

#: Number words.
ONES = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
BIG = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
#: Scale words and suffixes of money.
SCALES = {"thousand": 10**3, "k": 10**3, "million": 10**6, "mm": 10**6, "mn": 10**6, "m": 10**6, "billion": 10**9, "bn": 10**9, "b": 10**9, "trillion": 10**12}
MONEY = r"(?i)\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?(thousand|million|billion|trillion|mm|mn|bn|k|m|b)?\b"


def grouped_number(x: Column | str) -> Column:
    """A decimal from plain or properly grouped digits; 1,2 and the like give null."""
    s = _c(x)
    fine = s.rlike(r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$|^[0-9]+(\.[0-9]+)?$|^\.[0-9]+$")
    return F.when(fine, F.regexp_replace(s, ",", "").try_cast("decimal(38,6)"))


def money_cents(x: Column | str) -> Column:
    """Cents of the first amount in dollars, scale words and suffixes applied; halves to even."""
    n = grouped_number(F.regexp_extract(_c(x), MONEY, 1))
    unit = F.lower(F.regexp_extract(_c(x), MONEY, 2))
    factor = F.coalesce(F.create_map(*[F.lit(v) for kv in SCALES.items() for v in kv])[unit], F.lit(1))
    return F.bround(n.cast("decimal(24,6)") * factor.cast("decimal(13,0)") * 100, 0).cast("long")


def percent_bps(x: Column | str) -> Column:
    """Basis points of the first percentage."""
    return (grouped_number(F.regexp_extract(_c(x), r"([0-9][0-9,]*(?:\.[0-9]+)?)\s?(?:%|percent\b)", 1)).cast("decimal(20,6)") * 100).cast("decimal(20,6)")


def numeric_key(x: Column | str) -> Column:
    """One string for equal numbers: no trailing zeros, no leading +."""
    d = _c(x).try_cast("decimal(38,6)")
    return F.when(d.isNotNull(), F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))


def count_anchors(x: Column | str) -> Column:
    """Counts: grouped by commas, or 4 to 9 digits outside 1800-2199; as longs."""
    raw = F.filter(matches(x, r"(?<![0-9A-Za-z$.,])([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{4,9})(?![0-9A-Za-z%]|[.,][0-9])", 1), lambda v: v != "")
    n = F.transform(raw, lambda v: F.struct(v.alias("t"), F.regexp_replace(v, ",", "").cast("long").alias("n")))
    return F.transform(F.filter(n, lambda v: F.contains(v["t"], F.lit(",")) | ~v["n"].between(1800, 2199)), lambda v: v["n"])


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


# --- D: dates ------------------------------------------------------------------------------------------------------


def unambiguous_date(x: Column | str) -> Column:
    """ISO date of an ISO, month-name or d/m/y date; two different fields up to 12 are ambiguous and give null."""
    s = F.trim(_c(x))
    a, b = F.regexp_extract(s, r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.][0-9]{4}$", 1).try_cast("int"), F.regexp_extract(s, r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.][0-9]{4}$", 2).try_cast("int")
    y = F.regexp_extract(s, r"([0-9]{4})$", 1)
    day, month = F.when(a > 12, a).otherwise(b), F.when(a > 12, b).otherwise(a)
    slashed = F.when((a <= 12) & (b <= 12) & (a != b), None).otherwise(F.concat_ws("-", y, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))
    iso = F.coalesce(F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s), F.when(a.isNotNull(), slashed))
    named = F.coalesce(F.try_to_date(s, "MMMM d, yyyy"), F.try_to_date(s, "d MMMM yyyy"))
    return F.date_format(F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), named), "yyyy-MM-dd")


def whole_months(start: Column, end: Column) -> Column:
    """Calendar months between, by comparison with add_months instead of months_between's fractions."""
    guess = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.when(F.add_months(start, guess) > end, guess - 1).otherwise(guess)


def days_of(n: Column, unit: Column) -> Column:
    """Approximate days: years 365, months 30, weeks 7."""
    u = F.lower(F.regexp_replace(unit, "s$", ""))
    return n.cast("long") * F.when(u == "year", 365).when(u == "month", 30).when(u == "week", 7).when(u == "day", 1)


def date_readings(x: Column | str) -> Column:
    """Struct of month_first, day_first (ISO; each the only reading where the other is none) and ambiguous, for d/m/y or m/d/y."""
    part = [F.regexp_extract(F.trim(_c(x)), r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})$", k).try_cast("int") for k in (1, 2, 3)]
    iso = lambda m, d: F.date_format(F.try_to_date(F.format_string("%d-%d-%d", part[2], m, d), "y-M-d"), "yyyy-MM-dd")
    a, b = iso(part[0], part[1]), iso(part[1], part[0])
    return F.struct(F.coalesce(a, b).alias("month_first"), F.coalesce(b, a).alias("day_first"), (a.isNotNull() & b.isNotNull() & (a != b)).alias("ambiguous"))


def to_roman(n: Column) -> Column:
    """A number below 1000 in lower-case roman numerals."""
    digit = lambda k, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (F.floor(n / k) % 10).cast("int") + 1)
    return F.concat(digit(100, "c", "d", "m"), digit(10, "x", "l", "c"), digit(1, "i", "v", "x"))


def from_roman(x: Column | str) -> Column:
    """The value of a well-formed numeral below 1000, in either case; null for others."""
    values = F.create_map(*[F.lit(v) for kv in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for v in kv])
    digits = F.transform(F.filter(F.split(F.lower(_c(x)), ""), lambda c: c != ""), lambda c: F.element_at(values, c))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    # A smaller digit before a larger one is taken away: twice, as it was added.
    total = F.aggregate(digits, zero, lambda a, v: F.struct((a["sum"] + v - F.when(a["last"] < v, 2 * a["last"]).otherwise(0)).alias("sum"), v.alias("last")), lambda a: a["sum"])
    return F.when(to_roman(total) == F.lower(_c(x)), total)


def simple_stem(x: Column | str) -> Column:
    """A word without a plural or a common ending."""
    w = _c(x)
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when(w.rlike("ies$") & (F.length(w) > 5), F.concat(cut(3), F.lit("y"))).when(w.rlike("(?:ing|est)$") & (F.length(w) > 6), cut(3)).when(w.rlike("ed$") & (F.length(w) > 5), cut(2))
        .when(w.rlike("[^s]s$"), cut(1)).otherwise(w)
    )


def strip_artifacts(x: Column | str) -> Column:
    """No slide or page prefix, glyph codes and soft hyphens; spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(x), r"^(?:Slide|Page) [0-9]+[:.] *", ""), r"\(cid:[0-9]+\)", " "), "\u00ad", "")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " "))
