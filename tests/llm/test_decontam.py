"""Decontamination against a plain search: several parts, odd rows, spans."""

import random
import re

import pytest

from attestlake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        for k in range(max(1, len(b) - n + 1)) if b else ():
            gram = b[k : k + n]
            for p in range(len(w) - len(gram) + 1):
                if w[p : p + len(gram)] == gram:
                    hit |= set(range(p, p + len(gram)))
                    found |= {i} - {None}
    return len(w), sorted(hit), sorted(found)


def corpus():
    r = random.Random(2)
    word = lambda: r.choice(["ab", "Cd", "ef", "été", "x1", "zz", "Q", "mn"])
    items = [(i, " ".join(word() for _ in range(r.randint(11, 16)))) for i in range(12)]
    items += [(3, "short one"), (20, None), (21, ""), (22, "..."), (None, "nameless item of five words"), (23, items[0][1]), (23, items[0][1])]
    docs = []
    for i in range(60):
        t = [word() for _ in range(r.randint(0, 40))]
        if i % 3 == 0:
            t[len(t) // 2 : len(t) // 2] = r.choice([x for _, x in items if x]).split()
        docs.append((i, r.choice([" ", ", ", "\n"]).join(t)))
    docs += [(None, None), (None, items[1][1]), (7, ""), (7, "a SHORT one!"), (7, "a SHORT one!"), (8, "nameless item of five words" * 2), (9, "word " * 20_000 + items[2][1])]
    return docs, items


@pytest.mark.parametrize("max_windows", [500_000, 20])
def test_against_plain_search(spark, max_windows):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, K1 string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_words, list(r.hit_words), list(r.item_ids)) for r in decontam.find_leaks(df, bench, max_windows=max_windows).collect()), key=str)
    assert got == sorted(((i, t, *plain(t, items)) for i, t in docs), key=str)
    kept = decontam.drop_contaminated(df, bench, max_windows=max_windows)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in docs if not plain(t, items)[1]), key=str)


def test_spans_go(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Before. One, two three four five six\nseven eight nine TEN eleven! After."), (2, None), (3, "clean é")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in decontam.remove_spans(df, bench).collect()} == {1: "Before. ! After.", 2: None, 3: "clean é"}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, bench).first().n_words == 3 and decontam.drop_contaminated(docs, bench).count() == 1
    assert decontam.find_leaks(docs.where("false"), bench).count() == 0
