"""Pairs that meet by keys instead of all pairs: short needles, short quotes, near vectors and repaired quotes against plain search."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from attestlake.kernel.sentences import match_form, repair_quote
from attestlake.operators import attest, vectors, verify

WORDS = "a ab abc abcd abcde xabcde market markets ark İx naïve ab- 12 1234567".split()


def texts(seed, n, most):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("most", [attest.MOST_NEEDLES, 0])
def test_needles_of_any_length(spark, monkeypatch, most):
    monkeypatch.setattr(attest, "MOST_NEEDLES", most)
    bodies = texts(1, 60, 12) + [None, "", "abcd", "abcd"]
    needles = ["", "a", "b", "rk", "bcd", "arket", "ab abc", "b a", "e m", "cd abcd", "İx n", "bcde market a", "d abcd e", None, "zz", "q q"] + texts(2, 40, 5)
    src = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    got = sorted(tuple(r) for r in attest.containment(spark.createDataFrame([(x,) for x in needles], "needle string"), src, "needle", "body").collect())
    assert got == sorted((i, n) for i, b in enumerate(bodies) for n in {x for x in needles if x is not None} if n in (b or ""))


def test_containment_has_no_nested_loop(spark):
    df = spark.createDataFrame([(1, "abc de")], "id long, body string")
    plan = attest.containment(df.select(df.body.alias("needle")), df, "needle", "body")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_needles_beyond_the_bytes_of_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(attest, "MOST_BYTES", 10)
    df = spark.createDataFrame([(1, "one two three four five six")], "id long, body string")
    needles = spark.createDataFrame([("two three four five",), ("ne two three fo",), ("two four three x",)], "needle string")
    assert sorted(r.needle for r in attest.containment(needles, df, "needle", "body").collect()) == ["ne two three fo", "two three four five"]


def test_short_quotes(spark):
    bodies = ["A market here", "The markets fell", "abcd", "supermarket fell", "İx", ""]
    quotes = ["market", "Market", "a", "M", "market here", "A market", "t here", "markets fell", "arkets", "Markets [x] fell", "nothing here", "the Markets"]
    claims = spark.createDataFrame([("s", i, f'It says "{x}" there.') for i, x in enumerate(quotes)], "scope string, claim_id long, claim string")
    src = spark.createDataFrame([("s", i, b, True) for i, b in enumerate(bodies)], "scope string, source_id long, text string, complete boolean")
    got = {r.quote: r.state for r in verify.quote_states(claims, src, "scope").collect()}

    def held(q, b):
        return all(any(v in b for v in (p, p[0].upper() + p[1:], p[0].lower() + p[1:])) for p in (x.strip() for x in q.split("[x]")))

    assert got == {q: "verified" if any(held(q, b) for b in bodies) else "altered" for q in quotes}


@pytest.mark.parametrize("kind", ["random", "ties", "huge", "near"])
def test_nearest_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "STEP", 7)
    r = np.random.default_rng(6)
    x = r.standard_normal((120, 6))
    x = {"random": x, "ties": np.round(x), "huge": x * 1e200, "near": 1e6 + 1e-7 * x}[kind]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0])], "id long, v array<double>")
    got = {}
    for row in sorted(vectors.nearest(rows, rows.where("id % 10 = 0"), "id", "v", 5, 50, 6).collect(), key=lambda t: t["rank"]):
        got.setdefault(row.query_id, []).append((row.id, row.distance))
    with np.errstate(over="ignore"):
        for q in range(0, 120, 10):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            best = [i for i in np.lexsort((np.arange(120), d)) if i != q and np.isfinite(d[i])][:5]
            assert got.get(q, []) == [(i, d[i]) for i in best]


def test_repaired_quotes():
    r = random.Random(3)
    kept = 0
    for _ in range(3000):
        source = "".join(r.choice("ab c") for _ in range(r.randint(0, 120)))
        at = r.randrange(len(source) + 1)
        quote = list(source[at : at + r.choice([3, 30, 60, 90])])
        for _ in range(r.randint(0, 2)):
            if quote:
                quote[r.choice([0, -1, r.randrange(len(quote))])] = r.choice("abx")
        quote = "".join(quote)
        s, places = match_form(source)
        q, _ = match_form(quote)
        m = SequenceMatcher(None, q, s, autojunk=False).find_longest_match()
        i = s.find(q) if q else -1
        if i >= 0:
            want = source[places[i] : places[i + len(q) - 1] + 1]
        else:
            want = source[places[m.b] : places[m.b + m.size - 1] + 1] if m.size and m.size >= max(0.95 * len(q), min(40, len(q))) else None
            kept += want is not None
        assert repair_quote(quote, source) == want
    assert kept > 20
