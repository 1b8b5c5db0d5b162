import random
from collections import Counter

import pytest

from attestlake.llm import bagminhash as B


def brute(docs):
    """Classes by comparing all pairs of shingle counters."""
    bags = {}
    for i, t in docs:
        w = "".join(c.lower() if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t or "").split()
        n = min(5, len(w))
        bags[i] = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b and bags[a] and bags[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus(seed=3, n=60, copies=40):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("aeiou") + r.choice("klmnprst") + r.choice("aeiou")
    docs = [" ".join(word() for _ in range(r.randint(1, 120))) for _ in range(n)]
    base = [word() for _ in range(100)]
    for _ in range(copies):
        c = list(base)
        for _ in range(r.randint(0, 3)):
            c[r.randrange(len(c))] = word()
        docs.append(" ".join(c))
    docs += [docs[0], docs[0] + "!", "der " * 300, "der " * 280, "der " * 100, "one two", "One, two", "", None, "...", "é è"]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [1024, 8])
def test_classes_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "PIVOTS", 2 if block == 8 else 32)
    docs = corpus()
    got = B.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] for r in got)


def test_chained_copies_in_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 16)
    monkeypatch.setattr(B, "PIVOTS", 2)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    docs, now = [], [word() for _ in range(150)]
    for i in range(90):  # neighbours are alike, distant links are not
        docs.append((i, " ".join(now)))
        now[r.randrange(150)] = word()
    for i in range(90, 110):  # too far from all others, though they share buckets with them
        far = list(now)
        for k in r.sample(range(150), 10):
            far[k] = word()
        docs.append((i, " ".join(far)))
    got = {x.doc_id: x.class_id for x in B.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_texts_that_share_an_id_keep_their_own_links(spark):
    r = random.Random(9)
    text = lambda: [r.choice("abcdefgh") + r.choice("aeiou") + str(r.randrange(90)) for _ in range(80)]
    rows, want = [], set()
    for g in range(30):
        a, b = text(), text()
        near_a, near_b = a[:-1] + ["x"], b[:-1] + ["y"]
        rows += [(10 * g, " ".join(a)), (10 * g, " ".join(b)), (10 * g + 1, " ".join(near_a)), (10 * g + 2, " ".join(near_b))]
        want |= {(10 * g + 1, 10 * g), (10 * g + 2, 10 * g)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = B.near_duplicates(df).collect()
    assert want <= {(x.doc_id, x.class_id) for x in got}
    assert Counter(Counter(x.class_key for x in got).values()) == {2: 60}
    assert B.keep_one(df).count() == 60


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, "a b c d e f", None), (3, None, "n"), (4, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, K1 string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.class_size) for r in B.near_duplicates(df).collect())
    assert got == [(-1, 1, 4), (1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 3, 1), (4, 4, 1)]
    kept = B.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    no_ids = spark.createDataFrame([(None, "a b c"), (None, "A b c"), (None, "d e f"), (None, "")], "doc_id long, text string")
    assert B.keep_one(no_ids).count() == 3


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert B.near_duplicates(empty).count() == 0 and B.keep_one(empty).count() == 0
