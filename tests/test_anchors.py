"""Anchors of sentences of all types, and the readings that have to be refused."""

import pytest
from pyspark.sql import functions as F

from attestlake.functions import anchors as A

CASES = [
    ("Smith v. Jones, 410 U.S. 113 held so, and 12 F. Supp. 3d 99 too.", [("citation", "410 U.S. 113", "410 u.s. 113"), ("citation", "12 F. Supp. 3d 99", "12 f. supp. 3d 99")]),
    ("See No. 21-1234, slip op. at 3.", [("slip_op", "No. 21-1234", "no. 21-1234"), ("slip_op", "slip op.", "slip op.")]),
    ('He said "we will pay" twice.', [("quote", "we will pay", None)]),
    ('An open " quote is none.', []),
    ("It costs $1,250.50 now.", [("money", "$1,250.50", "125050")]),
    ("It costs $2.5 million, then $3k.", [("money", "$2.5 million", "250000000"), ("money", "$3k", "300000")]),
    ("Refused: $1,2 million.", []),
    ("The fee is five hundred thousand dollars.", [("money", "five hundred thousand dollars", "50000000")]),
    ("A grant of a million dollars.", [("money", "a million dollars", "100000000")]),
    ("Sales of 3.2 million and EUR 5 bn.", [("magnitude", "3.2 million", "3200000"), ("magnitude", "EUR 5 bn", "5000000000")]),
    ("Within 30 days or (2) years.", [("duration", "30 days", "30"), ("duration", "(2) years", "730")]),
    ("Signed March 5, 2021 and 2020-02-30 and 03/04/2020 and 25/12/2020.", [("date", "March 5, 2021", "2021-03-05"), ("date", "25/12/2020", "2020-12-25")]),
    ("A rate of 7.5% LIBOR plus 250 bps.", [("percent", "7.5%", "750"), ("percent", "250 bps", "250")]),
    ("Between 5% and 10% only.", [("percent", "5%", "500")]),
    ("Under Section 4.2(a) and § 9.", [("section", "Section 4.2(a)", "4.2(a)"), ("section", "§ 9", "9")]),
    ("This is governed by the laws of the State of New York.", [("governing_law", "New York", "new york")]),
    ("The laws of England and Wales govern it; Delaware law shall apply; she lives in Texas.", [("governing_law", "England and Wales", "england and wales"), ("governing_law", "Delaware", "delaware")]),
    ("A non-exclusive, worldwide license is given.", [("polarity", "non-exclusive", "exclusive:license-")]),
    ("The fees are refundable.", [("polarity", "refundable", "refundable:fee+")]),
    ("It is not an exclusive license.", []),
    ("An irrevocable offer.", [("polarity", "irrevocable", "revocable:offer-")]),
    ("Acme Widgets, Inc. and the Licensee agree.", [("party", "Acme Widgets, Inc.", "acme widgets inc"), ("party", "Licensee", "licensee")]),
    ("Give 500 mg and 2,000 kg of it.", [("quantity", "500 mg", "500000"), ("quantity", "2,000 kg", "2000000000000")]),
    ("It has 12,500 rows, 40123 keys, and dates from 1999.", [("count", "12,500", "12500"), ("count", "40123", "40123")]),
    ("1.500 kg is refused.", []),
    ("Nothing here.", []),
    (None, []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "id int, s string")
    got = {r.id: [(a.type, a.text, a.canonical) for a in r.a or []] for r in df.select("id", A.anchors("s").alias("a")).collect()}
    wrong = [(s, got[i], want) for i, (s, want) in enumerate(CASES) if got[i] != want]
    assert not wrong, wrong


def test_spans_and_subjects(spark):
    s = "\U0001f600 pay $5 for 7% Alpha in 3 weeks, or 10 km."
    rows = spark.createDataFrame([(s,)], "s string").select(F.inline(A.anchors("s"))).collect()
    assert all(s[r.start : r.end] == r.text for r in rows)
    assert [(r.type, r.subject) for r in rows] == [("money", None), ("percent", "Alpha"), ("duration", "week"), ("quantity", "distance")]


def test_defined_terms(spark):
    text = 'Acme (the "Fund") pays. "Net Price" means the price. The Fund grows, Funds do not. See the "Other".'
    df = spark.createDataFrame([(text,)], "s string").select("s", F.explode(A.defined_terms("s")).alias("term"))
    assert [(r.term, [text[a.start : a.end] for a in r.u], len(r.u)) for r in df.select("term", A.uses_of(F.col("s"), F.col("term")).alias("u")).collect()] == [("Fund", ["Fund"] * 2, 2), ("Net Price", ["Net Price"], 1)]


@pytest.mark.parametrize(("words", "value"), [
    ("one", 1), ("twenty-one", 21), ("nineteen hundred", None), ("nine hundred ninety nine", 999), ("two million three hundred thousand five", 2_300_005), ("thousand", None), ("twenty thirty", None),
    ("five six", None), ("one hundred and five", None), ("zero", 0), ("", None), ("million one", None), ("one thousand two million", None), ("forty two thousand", 42_000), ("one hundred twelve", 112), ("ten five", None),
])
def test_cardinals(spark, words, value):
    assert spark.range(1).select(A.cardinal(F.lit(words)).alias("v")).first().v == value


def test_sentences(spark):
    from attestlake.functions import text as X

    s = 'Smith v. Jones was No. 4. It held, "Yes." Then J. Doe left\nLine two! (Really?) 3 cats. end. 12. Heading\n\n  A.B. Inc. pays.  '
    rows = spark.createDataFrame([(s,), (None,), ("",)], "s string").select(F.inline(X.sentence_spans("s"))).collect()
    assert [r.sentence for r in rows] == ["Smith v. Jones was No. 4.", 'It held, "Yes."', "Then J. Doe left", "Line two!", "(Really?)", "3 cats. end.", "12.", "Heading", "A.B. Inc. pays."]
    assert all(s[r.start :].startswith(r.sentence) for r in rows)
