"""Contradictions inside texts and between them, as joins and aggregates over sentences, anchors and lines.

Every detector gives id, detector, verdict (contradicted, or could_not_verify where the text can't be read for sure) and
detail; consistent texts give no rows. Sentences go through map-only expressions; what has to meet (terms, references,
clauses, table rows) meets by keys of its own text, so no text is gathered in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestlake.functions import anchors as A
from attestlake.functions import text as X
from attestlake.operators import attest
from attestlake.operators.lineage import once_per_text
from attestlake.operators.relational import exploded

CONTRADICTED, REFUSED = "contradicted", "could_not_verify"
#: Days by which an interval may differ before it is called wrong: days and weeks, months and years.
NEAR_DAYS, NEAR_MONTHS = 1, 3


def _finding(name: str, verdict: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("detector"), verdict.alias("verdict"), detail.alias("detail"))


def _findings(df: DataFrame, id_: str, found: Column) -> DataFrame:
    return exploded(df, found, "f", id_).select(id_, "f.*").where("verdict IS NOT NULL")


def words_figures(s: DataFrame, id_: str) -> DataFrame:
    """A cardinal in words against the figure in brackets after it. Not after Section and the like."""
    spoken = rf"(?i)\b({A._WORD}(?:[\s-]+(?:{A._WORD}|and))*)\s+(dollars\s+)?\(\s*(\$)?\s*(\d[\d,]*)\s*\)"
    got = F.filter(A.pieces(F.col("sentence"), spoken), lambda p: ~p["before"].rlike(r"(?i)\b(?:section|article|clause|schedule|exhibit)\s+$"))

    def read(p: Column) -> Column:
        part = [F.regexp_extract(p["text"], spoken, k) for k in range(1, 5)]
        w, n = A.cardinal(part[0]), X.grouped_number(part[3])
        verdict = (
            F.when((part[2] != "") & (part[1] == ""), None).when(w.isNull() | n.isNull() | ((part[1] != "") & (part[2] == "")), REFUSED).when(w != n, CONTRADICTED)
        )
        return _finding("words_figures", verdict, p["text"])

    return _findings(s.where(F.col("sentence").rlike(r"\(\s*\$?\s*\d")), id_, F.transform(got, read))


def _days_between(a: Column, b: Column) -> Column:
    return F.datediff(b.cast("date"), a.cast("date"))


def date_durations(s: DataFrame, id_: str) -> DataFrame:
    """From one date to another against the stated number of days, weeks, months or years in the same sentence."""
    a = s.where(F.col("sentence").rlike(r"(?i)\bfrom\b.*\b(?:to|through|until)\b") & F.col("sentence").rlike(r"(?i)\d\)?\s+(?:business\s+|calendar\s+)?(?:day|week|month|year)s?\b"))
    dated = r"\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d\d-\d\d|(?:" + "|".join(A.MONTHS) + r")\s+\d{1,2},\s+\d{4}"
    a = a.select(id_, "sentence", X.matches("sentence", dated).alias("dates"), X.matches("sentence", r"(?i)(\d{1,6})\)?\s+(?:business\s+|calendar\s+)?(?:day|week|month|year)s?\b").alias("spans"))
    a = a.where("size(dates) = 2 AND size(spans) = 1")
    a = a.withColumn("d1", X.unambiguous_date(F.get("dates", F.lit(0)))).withColumn("d2", X.unambiguous_date(F.get("dates", F.lit(1)))).withColumn("n", F.regexp_extract(F.get("spans", F.lit(0)), r"\d+", 0).cast("int"))
    unit = F.lower(F.regexp_extract(F.get("spans", F.lit(0)), r"(?i)(day|week|month|year)", 1))
    d1, d2, n = F.col("d1").cast("date"), F.col("d2").cast("date"), F.col("n")
    target, gap = F.when(unit == "week", n * 7).otherwise(n), F.datediff(d2, d1)
    off = F.when(gap < 0, 10**6).otherwise(F.least(F.abs(target - gap), F.abs(target - gap - 1)))
    end = F.add_months(d1, F.when(unit == "year", n * 12).otherwise(n))
    far = F.when(gap < 0, 10**6).otherwise(F.least(F.abs(F.datediff(d2, end)), F.abs(F.datediff(d2, F.date_sub(end, 1)))))
    by = lambda x, near: F.when(x > near, CONTRADICTED).when(x > 0, REFUSED)
    verdict = F.when(F.lower("sentence").rlike(r"\bbusiness\s+days?\b") | d1.isNull() | d2.isNull(), REFUSED).when(unit.isin("day", "week"), by(off, NEAR_DAYS)).otherwise(by(far, NEAR_MONTHS))
    return _findings(a, id_, F.array(_finding("date_duration", verdict, F.concat_ws(" ", F.get("dates", F.lit(0)), F.get("dates", F.lit(1)), F.get("spans", F.lit(0))))))


FLOOR, CEILING = r"(?i)\b(?:at\s+least|(?:no|not)\s+less\s+than|minimum\s+of)\s*$", r"(?i)\b(?:at\s+most|(?:no|not)\s+more\s+than|not\s+(?:to\s+)?exceed(?:ing)?|maximum\s+of|up\s+to)\s*$"


def bound_pairs(s: DataFrame, id_: str) -> DataFrame:
    """A floor above the ceiling of the same kind in one sentence; days against months are left open."""
    both = s.where(F.col("sentence").rlike(FLOOR[:-4] + r"\b") & F.col("sentence").rlike(CEILING[:-4] + r"\b"))
    kept = F.filter(A.figures("sentence"), lambda a: a["type"].isin(*A.FIGURES, "quantity", "count"))
    before = lambda a: F.substring("sentence", F.greatest(a["start"] - 29, F.lit(1)), F.least(a["start"], F.lit(30)))
    both = both.select(id_, "sentence", kept.alias("f")).select(
        id_, F.filter("f", lambda a: before(a).rlike(FLOOR)).alias("lo"), F.filter("f", lambda a: before(a).rlike(CEILING)).alias("hi"),
    )
    lo, hi = F.get("lo", F.lit(0)), F.get("hi", F.lit(0))
    value = lambda a: a["canonical"].cast("decimal(38,6)")
    family = lambda a: F.when(a["subject"].isin("month", "year"), "months").when(a["subject"].isin("day", "week"), "days").otherwise(F.coalesce(a["subject"], F.lit("")))
    clash = (lo["type"] == "duration") & (family(lo) != family(hi))
    same = (lo["type"] == hi["type"]) & ((lo["type"] == "percent") | (family(lo) == family(hi)))
    verdict = F.when((lo["type"] == hi["type"]) & clash, REFUSED).when(same & (value(lo) > value(hi)), CONTRADICTED)
    return _findings(both.where("size(lo) = 1 AND size(hi) = 1"), id_, F.array(_finding("bound_pair", verdict, F.concat_ws(" > ", lo["text"], hi["text"]))))


DECLARED = rf"(?i)\b(?:following|these)\s+(\d{{1,2}}|{A._WORD}(?:[\s-]{A._WORD})*)\s+\w[^:.;]{{0,60}}:"


def list_counts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """C4: a declared number of items against the markers (a), (b), ... or (1), (2), ... that follow up to the end of the paragraph."""
    body = F.regexp_extract(F.col(text), DECLARED + r"((?:[^\n]|\n(?!\s*\n))*)", 2)
    said = F.regexp_extract(F.col(text), DECLARED, 1)
    x = docs.where(F.col(text).rlike(DECLARED)).select(id_, F.coalesce(said.try_cast("int").cast("long"), A.cardinal(said)).alias("n"), F.regexp_extract(text, DECLARED, 0).alias("lead"), X.matches(body, r"(?<![\w)])\(([a-z]|\d{1,2})\)", 1).alias("m"), F.rtrim(body).alias("body"))
    place = lambda v: F.when(v.rlike(r"^\d"), v.try_cast("int")).otherwise(F.ascii(v) - 96)
    ordered = F.forall(F.sequence(F.lit(0), F.size("m") - 1), lambda i: place(F.get("m", i)) == i + 1)
    open_list = F.col("lead").rlike(r"(?i)\b(?:including|such\s+as|among|without\s+limitation|any|some)\b")
    count = F.size("m").cast("long")
    verdict = (
        F.when(open_list | (count == 0) | F.col("n").isNull(), None).when(~ordered, REFUSED).when(count == F.col("n"), None)
        .when((count < F.col("n")) & ~F.col("body").rlike(r"[.!?]$"), REFUSED).otherwise(CONTRADICTED)
    )
    return _findings(x, id_, F.array(_finding("list_count", verdict, F.concat_ws(" ", F.lit("declared"), F.col("n"), F.lit("found"), count))))


HEADING = r"(?m)^\s*(?:(?:Section|Clause|Article)\s+)?(\d{1,3}(?:\.\d{1,3}){0,4})\.?\s+[A-Z]"


def dangling_references(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """References to sections that the text has no heading for, nor for a part or a parent; texts without headings are silent.

    Both sides become dotted prefixes and meet on (id, prefix); the text itself stays behind.
    """
    heads = docs.select(id_, F.explode(F.array_distinct(X.matches(text, HEADING, 1))).alias("key"))
    refs = docs.select(id_, F.explode(F.array_distinct(X.matches(text, r"(?<!\n)(?<!^)\b(?:Section|Clause|Article)\s+(\d{1,3}(?:\.\d{1,3}){0,4})(?!\s+of\s+the\b|\s+thereof)(?![\d.]*\s+[A-Z][a-z]+\s*\n)", 1))).alias("key"))
    prefixes = lambda k: F.transform(F.sequence(F.lit(1), F.size(F.split(k, r"\."))), lambda i: F.array_join(F.slice(F.split(k, r"\."), F.lit(1), i), "."))
    # A heading answers a reference that it is, lies under, or holds.
    up = heads.select(id_, F.col("key").alias("p")).unionByName(heads.select(id_, F.explode(prefixes(F.col("key"))).alias("p"))).distinct()
    held = refs.select(id_, "key", F.explode(prefixes(F.col("key"))).alias("p")).join(heads.select(id_, F.col("key").alias("p")).distinct(), [id_, "p"], "left_semi").select(id_, "key")
    known = held.unionByName(refs.join(up.withColumnRenamed("p", "key"), [id_, "key"], "left_semi"))
    out = refs.join(known, [id_, "key"], "left_anti").join(heads.select(id_).distinct(), id_, "left_semi")
    return out.select(id_, F.lit("dangling_reference").alias("detector"), F.lit(CONTRADICTED).alias("verdict"), F.col("key").alias("detail"))


def clashing_definitions(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """A term that one text gives two different meanings."""
    means = r'["“]([A-Z][A-Za-z ]{1,40})["”]\s+(?:means|shall\s+mean)\s+([^.;\n]+)'
    terms, bodies = X.matches(text, means, 1), X.matches(text, means, 2)
    pairs = docs.select(id_, F.explode(F.arrays_zip(terms.alias("term"), F.transform(bodies, X.fold).alias("body"))).alias("d")).select(id_, "d.term", "d.body")
    out = pairs.groupBy(id_, "term").agg(F.countDistinct("body").alias("n")).where("n > 1")
    return out.select(id_, F.lit("clashing_definition").alias("detector"), F.lit(CONTRADICTED).alias("verdict"), F.col("term").alias("detail"))


#: Words of numbering, which make no defined term.
NUMBERING = ("Section", "Clause", "Article", "Schedule", "Exhibit", "Appendix", "Annex")
#: Unquoted uses that make a capitalized phrase look like a defined term.
LEAST_USES = 2


def term_uses(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Id, term (folded), shown, sites (its definitions), quoted and bare (its other uses in the style of a defined term): the term-use index.

    Bare uses are runs of two or more capitalized words inside a sentence. Uses that another text defines ("as defined in")
    don't count, nor do headings' numbering words.
    """
    elsewhere = r"(?!\s+(?:as\s+)?(?:defined|set\s+forth)\s+in)"
    site, said = X.matches(text, A.DEFINED, 1), X.matches(text, rf'["“]([A-Z][A-Za-z ]{{1,40}}?)["”]{elsewhere}', 1)
    bare = X.matches(text, rf"(?<=[a-z,;] )([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b(?! [A-Z]){elsewhere}", 1)
    bare = F.filter(bare, lambda p: ~p.rlike(rf"\b(?:{'|'.join(NUMBERING)})\b"))
    of = lambda a, kind: F.transform(a, lambda v: F.struct(v.alias("shown"), F.lit(kind).alias("kind")))
    rows = exploded(docs.where(F.col(text).rlike(A.DEFINED)), F.concat(of(site, "site"), of(said, "quoted"), of(bare, "bare")), "u", id_).select(id_, X.fold("u.shown").alias("term"), "u.*")
    n = lambda kind: F.count_if(F.col("kind") == kind)
    g = rows.groupBy(id_, "term").agg(F.min("shown").alias("shown"), n("site").alias("sites"), n("quoted").alias("quoted"), n("bare").alias("bare"))
    return g.withColumn("quoted", F.greatest(F.col("quoted") - F.col("sites"), F.lit(0)))


def undefined_terms(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Terms that a text with definitions uses, quoted or as often as LEAST_USES, and doesn't define: always left open."""
    u = term_uses(docs, id_, text).where((F.col("sites") == 0) & ((F.col("quoted") > 0) | (F.col("bare") >= LEAST_USES)))
    return u.select(id_, F.lit("undefined_term").alias("detector"), F.lit(REFUSED).alias("verdict"), F.col("shown").alias("detail"))


def unused_terms(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Terms that a text defines and never uses again, in any case and number: always left open. Terms defined in two ways are reported as that alone.

    Words are compared by their stems, the text with each of its own terms; nothing is shuffled but the clashes.
    """
    stems = lambda x: F.array_join(F.transform(X.matches(F.lower(x), "[a-z]+"), lambda w: X.simple_stem(w)), " ")
    x = docs.where(F.col(text).rlike(A.DEFINED)).select(id_, F.concat(F.lit(" "), stems(F.col(text)), F.lit(" ")).alias("body"), X.matches(text, A.DEFINED, 1).alias("sites"))

    def used(term: Column) -> Column:
        needle = F.concat(F.lit(" "), stems(term), F.lit(" "))
        times = (F.length("body") - F.length(F.replace("body", needle, F.lit(" ")))) / (F.length(needle) - 1)
        return times > F.size(F.filter("sites", lambda s: X.fold(s) == X.fold(term)))

    rows = exploded(x, F.filter(F.array_distinct("sites"), lambda v: ~used(v)), "detail", id_)
    clash = clashing_definitions(docs, id_, text).select(id_, "detail")
    return rows.join(clash, [id_, "detail"], "left_anti").select(id_, F.lit("unused_term").alias("detector"), F.lit(REFUSED).alias("verdict"), "detail")


NAME = r'(?:"[^"\n]{1,60}"|[A-Z]\w+(?: [A-Z]\w+){0,3})'
#: A clause that orders two events: name, how, count in words, count (in brackets or bare), kind of day, unit, side, name.
ORDERED = (
    rf"({NAME})(?: [a-z]+){{0,6}}? (?:(at least|no later than|no earlier than|within) )?(?:(?:([a-z-]+) \((\d{{1,4}})\)|(\d{{1,4}})) (?:(business|working|court|calendar) )?(day|week|month)s? )?"
    rf"(on or before|on or after|no later than|no earlier than|prior to|before|after|following|of) (?:the )?({NAME})"
)
#: A clause that dates an event: name, date (without a year in the last form).
DATED = rf"({NAME}) (?:is|are|falls|occurs|takes place|(?:shall|must|will) (?:be|occur|fall|take place))(?: (?:scheduled|set|due|held|made|filed|completed))?(?: (?:on|for))? (\d{{4}}-\d\d-\d\d|\d{{1,2}}/\d{{1,2}}/\d{{4}}|(?:{'|'.join(A.MONTHS)}) \d{{1,2}}(?:, \d{{4}})?)"
#: A text without any of these orders no events.
TIMED = r"\b(?:before|after|prior to|following|of|later|earlier)\b"
#: Least and most days of a unit.
UNIT_DAYS = {"day": (1, 1), "week": (7, 7), "month": (28, 31)}
MOST_CYCLES, DAY_ZERO = 32, "(day zero)"


def time_clauses(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Id, clauses: for each clause a, b (event names; b null for dates), low and high (bounds of a - b in days, or of a's date), business, clash, undated.

    Weeks are seven days and months 28 to 31, so bounds only ever get wider. Phrasings that bound nothing give null bounds.
    """
    flat = F.regexp_replace(F.col(text), r"\s+", " ")
    get = lambda c, pattern, i: F.regexp_extract(c, f"^(?:{pattern})$", i)
    name = lambda x: F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), "^[Tt]he ", "")

    def parts(c: Column) -> Column:
        """What the patterns give, each once: a lambda reads a pattern again wherever its value is used."""
        side = get(c, ORDERED, 8)
        n = F.coalesce(get(c, ORDERED, 4).try_cast("int"), get(c, ORDERED, 5).try_cast("int"))
        day = F.unix_date(F.to_date(X.unambiguous_date(F.nullif(get(c, DATED, 2), F.lit("")))))
        return F.struct(
            get(c, ORDERED, 2).alias("how"), F.when(side == "prior to", "before").when(side == "following", "after").otherwise(side).alias("side"), get(c, ORDERED, 7).alias("unit"), get(c, ORDERED, 6).alias("kind"), n.alias("n"),
            F.nullif(get(c, ORDERED, 3), F.lit("")).alias("said"), get(c, ORDERED, 1).alias("a"), get(c, ORDERED, 9).alias("b"), get(c, DATED, 1).alias("of"), day.alias("day"),
        )

    def sums(p: Column) -> Column:
        ends = [F.element_at(F.create_map(*[F.lit(v) for u, d in UNIT_DAYS.items() for v in (u, d[i])]), F.nullif(p["unit"], F.lit(""))) for i in (0, 1)]
        return F.struct(p.alias("p"), (p["n"] * ends[0]).alias("least"), (p["n"] * ends[1]).alias("most"), A.cardinal(p["said"]).alias("said"))

    def read(x: Column) -> Column:
        p, least, most, said = x["p"], x["least"], x["most"], x["said"]
        how, side, kind, n, day, dated = p["how"], p["side"], p["kind"], p["n"], p["day"], p["of"] != ""
        plain, none = (how == "") & n.isNull(), F.lit(None).cast("int")
        counted = lambda h, v: n.isNotNull() & (how == h) & (side == v)
        low = (
            F.when(plain & (side == "after"), 1).when(plain & side.isin("on or after", "no earlier than"), 0).when(counted("", "before"), -most).when(counted("", "after"), least).when(counted("", "of") | counted("within", "of"), -most)
            .when(counted("at least", "after") | counted("no earlier than", "after"), least).when(counted("within", "after"), 0).otherwise(none)
        )
        high = (
            F.when(plain & (side == "before"), -1).when(plain & side.isin("on or before", "no later than"), 0).when(counted("", "before"), -least).when(counted("", "after"), most).when(counted("", "of") | counted("within", "of"), most)
            .when(counted("at least", "before"), -least).when(counted("no later than", "after") | counted("within", "after"), most).otherwise(none)
        )
        return F.struct(
            name(F.when(dated, p["of"]).otherwise(p["a"])).alias("a"), F.when(~dated, name(p["b"])).alias("b"), F.when(dated, day).otherwise(low).cast("int").alias("low"), F.when(dated, day).otherwise(high).cast("int").alias("high"),
            (~dated & kind.isin("business", "working", "court")).alias("business"), F.coalesce(~dated & (said != n), F.lit(False)).alias("clash"), (dated & day.isNull()).alias("undated"),
        )

    some = docs.where(F.col(text).rlike(TIMED) & flat.rlike(ORDERED))
    return some.select(id_, F.transform(F.transform(F.transform(X.matches(flat, f"{DATED}|{ORDERED}"), parts), sums), read).alias("clauses"))


def negative_cycles(u: np.ndarray, v: np.ndarray, w: np.ndarray, clause: np.ndarray, n: int) -> list[np.ndarray]:
    """Cycles of negative length among edges t(v) - t(u) <= w over n nodes, as the clauses on them; each one's clauses leave the search.

    All nodes start at 0 (a source before all of them); a round relaxes every edge, until nothing gets shorter, or after n
    rounds what still does hangs on a cycle.
    """
    found, alive = [], np.ones(len(u), bool)
    while len(found) < MOST_CYCLES:
        e = np.flatnonzero(alive)
        e = e[np.argsort(v[e], kind="stable")]
        if not len(e):
            break
        heads = np.flatnonzero(np.append(True, v[e][1:] != v[e][:-1]))
        dist, by, at = np.zeros(n, np.int64), np.full(n, -1), v[e][heads]
        for _ in range(n + 1):
            reach = dist[u[e]] + w[e]
            best = np.minimum.reduceat(reach, heads)
            shorter = best < dist[at]
            if not shorter.any():
                break
            first = np.flatnonzero(reach == np.repeat(best, np.diff(np.append(heads, len(e)))))
            to = v[e][first]
            pick = first[np.append(True, to[1:] != to[:-1])]
            by[at[shorter]] = e[pick[shorter]]
            dist[at[shorter]] = best[shorter]
        else:
            node = at[shorter][0]
            for _ in range(n):
                node = u[by[node]]
            on, x = [], node
            while True:
                on.append(by[x])
                x = u[by[x]]
                if x == node:
                    break
            gone = np.unique(clause[on])
            found.append(gone)
            alive &= ~np.isin(clause, gone)
            continue
        break
    return found


def time_conflicts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """Clauses of a text that can't all hold: cycles of negative length among what they say of pairs of events, of any
    length, dates being distances from one day. A cycle with business days is left open, as are dates that can't be read
    of events that are ordered elsewhere, and counts whose words and figures differ. The detail names the events.

    A text's clauses are in one row and are relaxed there: no rounds of jobs. Equal texts are read once.
    """
    return once_per_text(docs.where(F.col(text).rlike(TIMED)), id_, text, _time_conflicts)


def _time_conflicts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """time_conflicts of texts that are distinct: no shuffle."""
    x = time_clauses(docs, id_, text)
    edge = lambda a, b, w, i, c: F.struct(a.alias("u"), b.alias("v"), w.cast("long").alias("w"), i.alias("i"), c["business"].alias("business"))

    def edges_of(c: Column, i: Column) -> Column:
        b = F.coalesce(c["b"], F.lit(DAY_ZERO))
        both = F.array(F.when(c["high"].isNotNull(), edge(b, c["a"], c["high"], i, c)), F.when(c["low"].isNotNull(), edge(c["a"], b, -c["low"], i, c)))
        return F.filter(both, lambda e: e.isNotNull() & ~c["clash"] & (c["a"] != b))

    ordered = F.flatten(F.transform(F.filter("clauses", lambda c: c["b"].isNotNull() & (c["low"].isNotNull() | c["high"].isNotNull())), lambda c: F.array(c["a"], c["b"])))
    kind = docs.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, verdicts, details = [], [], []
            for row, edges in enumerate(batch.column(1).to_pylist()):
                names = sorted({e[k] for e in edges for k in "uv"})
                number = {x: i for i, x in enumerate(names)}
                u, v = (np.array([number[e[k]] for e in edges], np.int64) for k in "uv")
                clause = np.array([e["i"] for e in edges])
                for gone in negative_cycles(u, v, np.array([e["w"] for e in edges]), clause, len(names)):
                    on = [e for e in edges if e["i"] in gone]
                    rows.append(row)
                    verdicts.append(REFUSED if any(e["business"] for e in on) else CONTRADICTED)
                    details.append(", ".join(sorted({e[k] for e in on for k in "uv"} - {DAY_ZERO})))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(verdicts, pa.string()), pa.array(details, pa.string())], [id_, "verdict", "detail"])

    edges = x.select(id_, F.flatten(F.transform("clauses", edges_of)).alias("edges")).where("size(edges) > 1")
    cycles = edges.mapInArrow(run, f"`{id_}` {kind}, verdict string, detail string")
    open_ = F.filter("clauses", lambda c: c["clash"] | (c["undated"] & F.array_contains(F.col("ordered"), c["a"])))
    refused = exploded(x.withColumn("ordered", ordered), open_, "c", id_).select(id_, F.lit(REFUSED).alias("verdict"), F.col("c.a").alias("detail"))
    return cycles.unionByName(refused).select(id_, F.lit("time_conflict").alias("detector"), "verdict", "detail")


CELL = r"\(?[$€£]?\s?\d[\d,]*(?:\.\d+)?\)?"


def cell_figure(x: Column) -> Column:
    """The amount of a table cell; brackets are a minus, currency signs and codes are left out, wrong grouping gives null."""
    bare = F.regexp_replace(F.trim(x), r"(?i)^(?:USD|EUR|GBP)\s+|[$€£()\s]", "")
    n = X.grouped_number(F.regexp_replace(bare, r"(?i)(?:thousand|million|billion)$", ""))
    scale = F.when(F.lower(bare).endswith("thousand"), 10**3).when(F.lower(bare).endswith("million"), 10**6).when(F.lower(bare).endswith("billion"), 10**9).otherwise(1)
    return F.when(F.trim(x).startswith("("), -1).otherwise(1) * (n.cast("decimal(24,4)") * scale.cast("decimal(11,0)")).cast("decimal(34,4)")


def table_rows(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, pos, label, amount, total of the lines that are a label and an amount."""
    line = docs.select(id_, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    shape = rf"^\s*([A-Za-z][^\d$€£(]*?)[\s:|.]+({CELL}(?:\s*(?:thousand|million|billion))?)\s*$"
    rows = line.where(F.col("line").rlike(shape)).select(id_, "pos", F.regexp_extract("line", shape, 1).alias("label"), cell_figure(F.regexp_extract("line", shape, 2)).alias("amount"))
    return rows.withColumn("total", F.lower("label").contains("total"))


def footing(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """A stated total against three readings: all items before it, the items since the last total, the totals
    before it and the items after the last of them. It stands if any fits; readings that differ, with none that fits, are
    left open, and so are rows that can't be read. Fewer than two items are silent."""
    w = Window.partitionBy(id_).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = table_rows(docs, id_, text)
    item = F.when(~F.col("total"), F.col("amount"))
    rows = rows.withColumn("all", F.sum(item).over(w)).withColumn("n", F.count_if(~F.col("total")).over(w)).withColumn("bad", F.count_if(F.col("amount").isNull()).over(w)).withColumn("part", F.count_if("total").over(w))
    v = Window.partitionBy(id_, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # The items of a part follow the total that ended the part before.
    rows = rows.withColumn("since", F.sum(item).over(v)).withColumn("totals", F.sum(F.when(F.col("total"), F.col("amount"))).over(w))
    zero = F.lit(0).cast("decimal(34,4)")
    tail = F.when(F.col("part") > 0, F.coalesce("totals", zero) + F.coalesce("since", zero)).otherwise(F.col("all"))
    since = F.coalesce("since", F.col("all"))
    stated = F.col("amount")
    verdict = (
        F.when(F.col("n") < 2, None).when(stated.isNull() | (F.col("bad") > 0), REFUSED).when((stated == F.col("all")) | (stated == since) | (stated == tail), None)
        .when((F.col("all") == since) & (since == tail), CONTRADICTED).otherwise(REFUSED)
    )
    return _findings(rows.where("total"), id_, F.array(_finding("footing", verdict, F.concat_ws(" ", "label", stated.cast("string"), F.lit("items"), F.col("all").cast("string")))))


BINDING = rf'["“]([A-Z][A-Za-z ]{{1,40}})["”]\s+(?:means|is|equals|shall\s+be|amounts\s+to)\s+(?:an?\s+amount\s+of\s+)?(approximately\s+|about\s+|at\s+most\s+|up\s+to\s+|at\s+least\s+)?(?={A._RAW}|\$)([^.;\n]{{1,40}})'


def bindings(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, term, dimension, value, hedge: the figures that texts bind to quoted terms."""
    got = F.arrays_zip(X.matches(text, BINDING, 1).alias("term"), X.matches(text, BINDING, 2).alias("hedge"), X.matches(text, BINDING, 3).alias("said"))
    rows = docs.where(F.col(text).rlike('["“]')).select(id_, F.explode(got).alias("b")).select(id_, "b.term", F.trim(F.lower("b.hedge")).alias("hedge"), F.get(A.figures("b.said"), F.lit(0)).alias("a"))
    a = F.col("a")
    dimension = (
        F.when(a["type"] == "duration", F.when(a["subject"].isin("month", "year"), "duration_months").otherwise("duration_days")).when(a["type"] == "money", "money_usd").when(a["type"] == "percent", "percent")
        .otherwise(F.concat_ws("_", a["type"], a["subject"]))
    )
    kind = F.when(F.col("hedge").isin("approximately", "about"), "approx").when(F.col("hedge").isin("at most", "up to"), "cap").when(F.col("hedge") == "at least", "floor").otherwise("")
    return rows.where(a["start"] == 0).select(id_, "term", dimension.alias("dimension"), a["canonical"].alias("value"), kind.alias("hedge"))


def _two(c: str) -> list[Column]:
    """Least and greatest: enough to tell one value from several, with partial aggregates of fixed size."""
    return [F.min(c).alias(f"{c}1"), F.max(c).alias(f"{c}2")]


def facts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """A term with two values in one dimension of one text; hedged ones, and days against months, are left open."""
    b = bindings(docs, id_, text)
    g = b.groupBy(id_, "term", "dimension").agg(*_two("value"), *_two("hedge")).where("value1 <> value2")
    hedged = (F.col("hedge1") != F.col("hedge2")) | (F.col("hedge1") == "approx")
    clash = g.select(id_, F.lit("fact").alias("detector"), F.when(hedged, REFUSED).otherwise(CONTRADICTED).alias("verdict"), F.concat_ws(" ", "term", "dimension", "value1", "value2").alias("detail"))
    mixed = b.where("dimension LIKE 'duration%'").groupBy(id_, "term").agg(*_two("dimension")).where("dimension1 <> dimension2")
    return clash.unionByName(mixed.select(id_, F.lit("fact").alias("detector"), F.lit(REFUSED).alias("verdict"), F.concat_ws(" ", "term", "dimension1", "dimension2").alias("detail")))


def facts_across(docs: DataFrame, set_id: str, id_: str, text: str, verbatim: str | None = None) -> DataFrame:
    """set_id, detector, verdict, detail: a term with different values in the documents of a set.

    Hedged values, a document at odds with itself, and documents marked as verbatim copies are left open.
    """
    mark = F.coalesce(F.col(verbatim), F.lit(False)) if verbatim else F.lit(False)
    b = bindings(docs.select(F.struct(F.col(set_id).alias("s"), F.col(id_).alias("d"), mark.alias("v")).alias("key"), text), "key", text)
    one = b.groupBy("key", "term", "dimension").agg(*_two("value"), F.max(F.col("hedge") != "").alias("hedged"))
    g = one.groupBy(F.col("key.s").alias(set_id), "term", "dimension").agg(
        F.min("value1").alias("lo"), F.max("value2").alias("hi"), F.max("hedged").alias("hedged"), F.max(F.col("value1") != F.col("value2")).alias("torn"), F.max("key.v").alias("copy"),
        F.min("key.d").alias("d1"), F.max("key.d").alias("d2"),
    ).where("lo <> hi AND d1 <> d2")
    verdict = F.when(F.col("hedged") | F.col("torn") | F.col("copy"), REFUSED).otherwise(CONTRADICTED)
    return g.select(set_id, F.lit("fact_across").alias("detector"), verdict.alias("verdict"), F.concat_ws(" ", "term", "dimension", "lo", "hi").alias("detail"))


def scan(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """All findings of single texts (C1 to C8). Equal texts are read once, and all detectors read them as written."""
    return once_per_text(docs, id_, text, _scan)


def _scan(docs: DataFrame, id_: str, text: str) -> DataFrame:
    s = attest.sentences(docs.where(F.col(text).rlike(r"\d")), id_, text)  # the three need a number
    out = words_figures(s, id_)
    for more in (date_durations(s, id_), bound_pairs(s, id_), *(f(docs, id_, text) for f in (list_counts, dangling_references, clashing_definitions, undefined_terms, unused_terms, _time_conflicts, footing, facts))):
        out = out.unionByName(more)
    return out
