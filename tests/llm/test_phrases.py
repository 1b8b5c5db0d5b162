"""Collocations against brute force: pieces, languages, cuts, ties, several parts, odd rows; the perfect hash alone."""

import re
from collections import Counter

import numpy as np

from attestlake.llm import phrases


def brute(rows, least, top=2000, longest=5):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items())
            if not inside:
                score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def texts(seed=1, docs=120):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "The", "new", "york", "city", "über", "x y", "a'b", "\U0001f600", "rare"]
    glue = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " ; "]
    out = []
    for i in range(docs):
        w = [words[min(int(rng.exponential(3)), 10)] for _ in range(60)]
        out.append(("en" if i % 3 else None if i % 2 else "de", "".join(x + glue[rng.integers(0, 9)] for x in w) + " New York City council!" * (i % 4)))
    return out


def test_against_brute_force(spark):
    rows = texts() + [("en", None), ("en", ""), (None, " \t.,"), ("fr", "alone"), ("en", "the of " * 20_000), ("en", "the of " * 3), ("en", "the of " * 3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, a int, rank string").repartition(7)
    for least, top in ((20, 2000), (50, 5)):
        got = found(phrases.collocations(df, min_count=least, top=top))
        assert got == brute(rows, least, top) and len({r[0] for r in got}) >= 2


def test_several_parts_and_few_cells(spark, monkeypatch):
    """Part after part gives the same; so do cells that keep nearly every phrase."""
    rows = texts(2, 60)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(40)
    want = brute(rows, 15)
    assert found(phrases.collocations(df, min_count=15, part=7)) == want
    monkeypatch.setattr(phrases, "MOST_CELLS", 1 << 12)
    assert found(phrases.collocations(df, min_count=15)) == want


def test_colliding_words_take_another_seed(spark):
    plain = phrases.word_hash
    rows = texts(3, 40)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(phrases.collocations(df, min_count=15, hashed=lambda lang, w, seed: 5 if seed == 0 and w in (b"new", b"york") else plain(lang, w, seed))) == brute(rows, 15)


def test_jobs_do_not_grow_with_partitions(spark):
    """Summed arrays come to the driver by one job, not by one after another for each shuffle partition."""
    rows = texts(4, 60)
    df, sc, jobs = spark.createDataFrame(rows, "lang string, text string").repartition(40), spark.sparkContext, []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (3, 23):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            sc.setJobGroup(f"phrases-{n}", "")
            assert found(phrases.collocations(df, min_count=15, longest=3)) == brute(rows, 15, longest=3)
            jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"phrases-{n}")))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert jobs[0] > 0 and jobs[1] < jobs[0] + 20, jobs


def test_empty(spark):
    df = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.where("false")).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 20_000))
    h = phrases.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert (h.slots(np.setdiff1d(rng.integers(-(1 << 62), 1 << 62, 9_000), keys)) == -1).all()
    assert (phrases.PerfectHash(np.zeros(0, np.int64)).slots(keys[:5]) == -1).all()
