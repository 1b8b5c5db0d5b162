"""The training-data queries against SQL where SQL can express them, else against public libraries or brute force."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from attestlake.llm import bpe, queries
from attestlake.llm.common import table
from tests.compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert difference(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF) is None


def test_url_filter_twice_in_a_session(spark):
    rows = [sorted(queries.op9_url_filter(spark, SF).collect(), key=str) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_bpe_against_tiktoken(spark):
    path = public_tokenizers.path(queries.TOKENIZER)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    for r in queries.op5_byte_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_hard_texts():
    path = public_tokenizers.path(queries.TOKENIZER)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.codec(path, public_tokenizers.PATTERN)
    for text in ["", " ", "\n\n \t x", "a" * 5000, "abcabd" * 900, "  x\x1c\x1dy\x85", "héllo 你好\U0001f600 ال", "it's I'LL 12² ٣", "<|endoftext|>"]:
        assert c.encode(text) == enc.encode_ordinary(text), text[:40]
        assert c.decode(c.encode(text)) == text.encode()


def test_bpe_queue_and_table(monkeypatch):
    path = public_tokenizers.path(queries.TOKENIZER)
    c = bpe.Codec(bpe.load_ranks(path), public_tokenizers.PATTERN)
    pushed, merged, push, merge = [], [], bpe.heappush, c.merge
    monkeypatch.setattr(bpe, "heappush", lambda h, x: (pushed.append(x), push(h, x)))
    # of equal pairs in a row only the first waits
    c.merge(b"z" * 1001)
    assert len(pushed) < 100
    # a frequent pre-token is merged once, however many rare ones pass
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 8)
    monkeypatch.setattr(c, "merge", lambda piece: (merged.append(piece), merge(piece))[1])
    for i in range(100):
        assert c.decode(c.encode(f"zqxwvk rare{i}q")).decode() == f"zqxwvk rare{i}q"
        assert len(c) + len(getattr(c, "older", ())) <= 8
    assert merged.count(b"zqxwvk") == 1


def test_neighbours_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    rows = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in queries.op4_rp_forest(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        mine = [got[q][k] for k in sorted(got[q])]
        assert len(mine) == len(best)
        for i, score in mine:
            assert abs(score - s[ids == i][0]) < 1e-9
        hit += len(set(best) & {i for i, _ in mine})
        total += len(best)
    assert hit / total >= 0.9


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect() if r.quality is not None}
    rows = queries.op10_quality(spark, sf).collect()
    for r in rows[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id in y]
    right = sum(r.predicted == y[r.doc_id] for r in held)
    assert right / len(held) >= 0.85
