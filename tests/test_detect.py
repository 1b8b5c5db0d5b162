"""Detectors on small texts: what contradicts, what has to be refused, what is silent."""

import numpy as np
import pytest

from attestlake.operators import attest, detect
from attestlake.operators.lineage import once_per_text

C, R = "contradicted", "could_not_verify"
TEXTS = {
    "words_figures": [
        ("Pay five (5) times.", None), ("Pay five (6) times.", C), ("Pay thirty thousand (30,000) units.", None), ("Pay twenty thirty (50) times.", R), ("See Section five (6).", None),
        ("Pay five dollars ($6).", C), ("Pay five dollars (6).", R), ("Pay five ($6).", None), ("Pay five (1,2) times.", R),
    ],
    "date_duration": [
        ("It runs from 2021-01-01 to 2021-01-31, 30 days.", None), ("It runs from 2021-01-01 to 2021-01-31, or 31 days.", None), ("It runs from 2021-01-01 to 2021-01-31, or 32 days.", R), ("It runs from 2021-01-01 to 2021-01-31, or 45 days.", C),
        ("It runs from 2021-01-15 to 2021-07-14, 6 months.", None), ("It runs from 2021-01-15 to 2021-07-17, 6 months.", R), ("It runs from 2021-01-15 to 2021-09-15, 6 months.", C), ("It runs from 01/02/2021 to 2021-09-15, 6 months.", R),
        ("It runs from 2021-03-01 to 2021-01-01, 30 days.", C), ("It runs from March 1, 2021 to March 15, 2021, 2 weeks.", None), ("It runs from 2021-01-01 to 2021-01-31, 10 business days.", R),
    ],
    "bound_pair": [
        ("A fee of at least $500 and at most $400 applies.", C), ("A fee of at least $400 and at most $500 applies.", None), ("At least 30 days and not more than 2 months.", R), ("At least 5% and no more than $3 apply.", None),
        ("Not less than 5% and up to 4.5%.", C), ("At least 3 weeks and at most 20 days.", C), ("A minimum of 500 kg and a maximum of 499 kg.", C),
    ],
    "list_count": [
        ("Deliver the following three items: (a) one; (b) two; (c) three.", None), ("Deliver the following three items: (a) one; (b) two.", C), ("Deliver the following 2 items: (1) one; (2) two; (3) three.", C),
        ("Deliver the following two items: (a) one; (c) two.", R), ("Deliver the following three items, such as: (a) one; (b) two.", None), ("Deliver the following three items: (a) one; (b) two and", R), ("Deliver the following three items: none.", None),
    ],
    "dangling_reference": [
        ("1. Scope\nAs in Section 2.1 above.\n2. Terms\nAs in Section 1.", None), ("1. Scope\nAs in Section 3 above.\n2. Terms", C), ("1. Scope\nAs in Section 9 of the Act.", None), ("As in Section 3 above.", None), ("2.1 Scope\nAs in Section 2.", None),
    ],
    "clashing_definition": [('"Fee" means the price. "Fee" means the  Price.', None), ('"Fee" means the price. Later "Fee" means the cost.', C)],
    "undefined_term": [
        ('"Fee" means the price. The Fee is due. We pay the Late Charge and then the Late Charge again.', R), ('"Fee" means the price. The Fee is due. We pay the Late Charge.', None), ("We pay the Late Charge and then the Late Charge again.", None),
        ('"Fee" means the price. The Fee and a "Bonus" are due.', R), ('"Fee" means the price. The Fee and a "Bonus" as defined in the Act are due.', None), ('"Fee" means the price. As in Section Two the Fee, and in Section Two more.', None),
        ('"Late Charge" means a sum. We pay the Late Charge and then the Late Charge again.', None),
    ],
    "unused_term": [
        ('"Fee" means the price.', R), ('"Fee" means the price. Two fees are due.', None), ('"Fee" means the price. Later "Fee" means the cost.', None), ('The price (the "Fee") is low. It is due.', R), ('The price (the "Fee") is low. The fee is due.', None),
        ('"Late Charge" means a sum. A late day is no charge.', R), ("No terms.", None),
    ],
    "time_conflict": [
        ("Closing shall occur before Filing. Filing shall occur before Closing.", C), ("Closing shall occur before Filing. Filing shall occur before Audit.", None),
        ("Audit shall occur at least 10 days after Closing. Audit shall occur no later than 5 days after Closing.", C), ("Audit shall occur at least 5 days after Closing. Audit shall occur no later than 5 days after Closing.", None),
        ("Audit must occur exactly 3 days after Closing. Closing must occur exactly 3 days after Filing. Audit must occur no later than 5 days after Filing.", C),
        ("The Closing is on 2021-01-10. The Filing is on 2021-01-01. The Closing shall be no later than seven (7) days after the Filing.", C), ("The Closing is on 2021-01-10. The Filing is on 2021-01-01. The Closing shall be no later than nine (9) days after the Filing.", None),
        ("The Closing shall occur at least 2 weeks after the Filing. The Closing shall occur within 10 days of the Filing.", C), ("The Closing shall occur 2 months after the Filing. The Closing shall occur no later than 60 days after the Filing.", None),
        ("The Closing shall occur 3 months after the Filing. The Closing shall occur no later than 80 days after the Filing.", C), ("Audit shall occur at least 10 business days after Closing. Audit shall occur no later than 5 days after Closing.", R),
        ("Audit shall occur at least ten (12) days after Closing.", R), ("The Closing is on 01/02/2021. The Closing shall occur before Filing.", R), ("The Closing is on 01/02/2021. Audit shall occur before Filing.", None),
        ("The Closing is on May 5. Filing shall occur after the Closing.", R), ("Closing shall occur within 5 days before Filing. Filing shall occur before Closing.", None), ('"Long Stop" shall occur before the Closing. The Closing shall occur prior to the Long Stop.', C),
    ],
    "footing": [
        ("Rent 100.00\nWater 20.50\nTotal 120.50", None), ("Rent 100.00\nWater 20.50\nTotal 121.50", C), ("Rent $1,000\nRebate (200)\nTotal $800", None), ("Rent 1,00\nWater 20\nTotal 120", R), ("Rent 100\nTotal 90", None),
        ("A 1\nB 2\nSubtotal 3\nC 4\nD 5\nSubtotal 9\nTotal 12", None), ("A 1\nB 2\nTotal 3\nC 4\nD 5\nTotal 10", R), ("A: 1 million\nB: 500 thousand\nTotal: 1.5 million", None),
    ],
    "fact": [
        ('"Cap" means $500. The "Cap" is $600.', C), ('"Cap" means $500. The "Cap" is $500.00.', None), ('"Cap" means about $500. The "Cap" is $600.', R), ('"Term" means 30 days. The "Term" is 2 months.', R), ('"Cap" means $500. The "Rate" is 5%.', None),
        ('"Cap" means up to $500. "Cap" means up to $600.', C),
    ],
}


def docs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_verdicts(spark, name):
    df = docs(spark, [t for t, _ in TEXTS[name]] + [None, ""])
    per_sentence = {"words_figures": detect.words_figures, "date_duration": detect.date_durations, "bound_pair": detect.bound_pairs}
    per_text = {"list_count": detect.list_counts, "dangling_reference": detect.dangling_references, "clashing_definition": detect.clashing_definitions, "undefined_term": detect.undefined_terms, "unused_term": detect.unused_terms, "time_conflict": detect.time_conflicts, "footing": detect.footing, "fact": detect.facts}
    got = per_sentence[name](attest.sentences(df, "id", "text"), "id") if name in per_sentence else per_text[name](df, "id", "text")
    found = {r.id: (r.detector, r.verdict) for r in got.collect()}
    wrong = [(t, want, found.get(i)) for i, (t, want) in enumerate(TEXTS[name]) if found.get(i, (name, None)) != (name, want)]
    assert not wrong and set(found) <= set(range(len(TEXTS[name]))), wrong


def test_facts_across_documents(spark):
    rows = [
        (1, "a", '"Cap" means $500.', False), (1, "b", 'The "Cap" is $600.', False), (2, "a", '"Cap" means $500.', False), (2, "b", 'The "Cap" is $500.', False), (3, "a", '"Cap" means $500.', True), (3, "b", 'The "Cap" is $600.', False),
        (4, "a", '"Cap" means $500. "Cap" is $700.', False), (4, "b", 'The "Cap" is $600.', False), (5, "a", '"Cap" means about $500.', False), (5, "b", 'The "Cap" is $600.', None),
    ]
    got = detect.facts_across(spark.createDataFrame(rows, "s int, d string, text string, v boolean"), "s", "d", "text", "v").collect()
    assert {r.s: r.verdict for r in got} == {1: C, 3: R, 4: R, 5: R}


def test_scan_unites(spark):
    got = detect.scan(docs(spark, ["Pay five (6) times. A fee of at least $500 and at most $400 applies.", "Nothing."]), "id", "text").collect()
    assert {(r.id, r.detector) for r in got} == {(0, "words_figures"), (0, "bound_pair")}


def test_long_chains_and_cycles_of_clauses(spark):
    """5 000 chained clauses are silent; closed to a cycle they are one finding. Random clauses against shortest paths by force."""
    chain = " ".join(f"E{i} shall occur before E{i + 1}." for i in range(5000))
    got = detect.time_conflicts(docs(spark, [chain, chain + " E5000 shall occur before E0."]), "id", "text").collect()
    assert [(r.id, r.verdict) for r in got] == [(1, C)] and got[0].detail.count("E") == 5001
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = 6, int(rng.integers(3, 14))
        u, v, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(-2, 6, m)
        dist = np.full((n, n), 10**6)
        np.minimum.at(dist, (u, v), w)
        for k in range(n):
            dist = np.minimum(dist, dist[:, k : k + 1] + dist[k : k + 1])
        cycles = detect.negative_cycles(u, v, w, np.arange(m), n)
        assert bool(len(cycles)) == bool((np.diag(dist) < 0).any())
        for gone in cycles:
            assert w[gone].sum() < 0 and sorted(u[gone]) == sorted(v[gone])


def test_equal_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def find(texts, key, text):
        def run(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        return texts.mapInArrow(run, texts.schema)

    docs = spark.createDataFrame([(i, f"text {i % 3}" if i % 4 else None) for i in range(1000)], "id long, s string")
    got = once_per_text(docs, "id", "s", find).collect()
    assert sorted((r.id, r.s) for r in got) == [(i, f"text {i % 3}") for i in range(1000) if i % 4] and read.value == 3


def test_findings_come_back_for_every_row_of_a_text(spark):
    clash = "Closing shall occur before Filing. Filing shall occur before Closing."
    docs = spark.createDataFrame([(i, clash if i % 2 else "Closing shall occur before Filing.") for i in range(50)] + [(99, None)], "id long, s string")
    for found in (detect.time_conflicts(docs, "id", "s"), detect.scan(docs, "id", "s")):
        assert sorted((r.id, r.detector, r.detail) for r in found.collect()) == [(i, "time_conflict", "Closing, Filing") for i in range(1, 50, 2)]
