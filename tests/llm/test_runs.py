"""Periodic runs against brute force: odd rows, random words, planted repetitions."""

import hashlib
import zlib

import numpy as np
import pytest

from attestlake.llm import queries, runs
from attestlake.llm.common import table


def brute(w):
    """(start, length, period) of all runs: every maximal stretch of every period, those of a smaller period left out."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and (i, j + p - i) not in out:
                if j + p - i >= 2 * p:
                    out[i, j + p - i] = p
            i = max(j, i) + 1
    return sorted((s, n, p) for (s, n), p in out.items() if n >= max(6, 4 * p))


def want(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(brute(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), sha(kept))


@pytest.mark.parametrize("kinds", [1, 2, 3, 9])
def test_random_words(kinds):
    rng = np.random.default_rng(kinds)
    for n in [*range(12), 40, 90, 150]:
        for _ in range(6):
            x = rng.integers(0, kinds, n)
            if n > 30:
                s, p = rng.integers(0, n // 2), rng.integers(1, 9)
                x[s:] = np.tile(x[s : s + p], n)[: n - s]
            assert [tuple(r) for r in runs.periodic_runs(x).tolist()] == brute(x.tolist())


def test_extensions():
    x = np.random.default_rng(5).integers(0, 2, 70)
    e = runs.Extensions(x)
    i, j = np.triu_indices(70, 1)
    plain = [next((k for k in range(70 - b) if x[a + k] != x[b + k]), 70 - b) for a, b in zip(i, j, strict=True)]
    assert e.of(i, j).tolist() == plain and e.of(np.array([3]), np.array([70])).tolist() == [0]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect())
    assert got == sorted(want(i, t) for i, t in docs.items())
    assert sum(r[1] > 0 for r in got) >= 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a " * 6), (5, "a " * 5), (6, "a b c " * 4), (6, "a b c " * 4), (None, "x y " * 4), (8, "w " * 30_000), (9, " ".join(map(str, range(50_000))))]
    rows += [(i, "eins zwei drei € " * (i % 9) + "end") for i in range(10, 60)]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, N_runs int, start string")
    key = lambda r: (r[0] is None, str(r))
    got = sorted((tuple(r) for r in runs.digests(runs.find_runs(runs.planted(df))).collect()), key=key)
    plain = sorted((want(*r) for r in rows if r[0] not in (8, 9)), key=key)
    assert [r for r in got if r[0] not in (8, 9)] == plain
    own = runs.find_runs(df)
    assert own.columns == ["doc_id", "text", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    one = own.where("doc_id = 8").first()
    assert (one.n_runs, one.start, one.length, one.period, one.collapsed) == (1, 0, 30_000, 1, "w")
    assert own.where("doc_id = 9").first().n_runs == 0 and runs.digests(runs.find_runs(df.where("false"))).count() == 0
