"""The pipeline's rows against a plain version of each of its stages."""

import base64
import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from attestlake.llm import quality, queries
from attestlake.llm.common import table
from tests.llm.test_near_duplicates import brute

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.translate(LOWER).strip(" \t\n\x0b\x0c\r")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows(w):
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def plain(docs, model, items):
    ids = sorted(docs)
    scores = model.score(quality.matrix([(docs[i] or "").encode() for i in ids]))
    good = {i: docs[i] for i, s in zip(ids, scores, strict=True) if s >= quality.THRESHOLD}
    n = Counter(k for t in good.values() for k in {key(x) for x in (t or "").split("\n")} if k)
    cut = {i: t and "\n".join(x for x in t.split("\n") if n[key(x)] < 10) for i, t in good.items()}
    root = brute(list(cut.items()))
    one = {i: t for i, t in cut.items() if root[i] == i}
    leaks = set().union(*map(windows, map(words, items)))
    lengths = {len(g) for g in leaks}

    def leaked(text):
        w = words(text)
        return any(tuple(w[i : i + k]) in leaks for k in lengths for i in range(len(w) - k + 1))

    return {i: t for i, t in one.items() if not leaked(t)}


def test_rows_against_plain_stages(spark):
    documents = table(spark, SF, "documents")
    docs = {r.doc_id: r.text for r in documents.collect()}
    model = quality.train(documents, table(spark, SF, "labels"))
    want = plain(docs, model, [r.text for r in table(spark, SF, "benchmark").collect()])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.TOKENIZER), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want) and 0 < len(got) < len(docs)
    for i, r in got.items():
        ids = enc.encode_ordinary(want[i] or "")
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((want[i] or "").encode()).hexdigest()


def test_stages_keep_columns_and_stand_odd_rows(spark):
    rows = [(None, "a b", "x", 1), (1, None, None, 2), (2, "", "x", 3), (2, "", "x", 3), (3, "One two three.\nSame line", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, n_lines int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= len(rows)
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
