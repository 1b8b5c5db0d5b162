"""Nearest neighbours against brute force: recall, share of rows reranked, shards, odd vectors and ties."""

import numpy as np
import pytest

from attestlake.llm import queries, rpforest
from attestlake.llm.common import table


def brute(rows, k=20, every=20):
    """{query: [(id, score)]} of rows (id, vector or None)."""
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, x in fine:
        if q % every == 0:
            s = {}
            for i, y in fine:
                if i != q and len(y) == len(x):
                    s[i] = max(s.get(i, -1e300), float((np.array(y, np.float64) * np.array(x, np.float64)).sum()))
            out[q] = sorted(s.items(), key=lambda t: (-t[1], t[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard_rows", [8192, 500])
def test_recall_on_the_whole_table(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(rpforest, "SHARD_ROWS", shard_rows)
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()}
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    got = found(queries.op4_rp_forest(spark, "/root/testdata/sf0.1"))
    hit = total = 0
    assert set(got) == {i for i in v if i % 20 == 0}
    for q, mine in got.items():
        s = (x * v[q]).sum(1)
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        assert len(mine) == 20 and all(score == s[ids == i][0] for i, score in mine)
        assert mine == sorted(mine, key=lambda t: (-t[1], t[0]))
        hit, total = hit + len(set(best) & {i for i, _ in mine}), total + 20
    assert hit / total >= 0.9


def measured(x, step=160, **how):
    """Recall, and the mean share of the rows that the opened leaves held, each of which was reranked."""
    forest = rpforest.Forest(np.arange(len(x)), x, 20)
    hit = seen = n = 0
    for q in range(0, len(x), step):
        ids, score, reranked = forest.search(q, x[q], 20, **how)
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        assert (score == s[ids]).all()
        hit, seen, n = hit + len(set(ids) & set(np.argsort(-s)[:20])), seen + reranked, n + 1
    return hit / (20 * n), seen / n / len(x)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("unit", [True, False])
def test_random_vectors_open_part_of_the_leaves(unit, seed):
    x = np.random.default_rng(seed).standard_normal((8192, 64))
    recall, share = measured(x / np.linalg.norm(x, axis=1)[:, None] if unit else x)
    assert recall >= 0.9 and share < 0.75


def test_clustered_vectors_open_few_leaves():
    r = np.random.default_rng(3)
    x = r.standard_normal((200, 64))[r.integers(0, 200, 8192)] + 0.1 * r.standard_normal((8192, 64))
    recall, share = measured(x / np.linalg.norm(x, axis=1)[:, None])
    assert recall >= 0.95 and share < 0.3


def test_every_candidate_of_an_opened_leaf_is_reranked():
    x = np.random.default_rng(4).standard_normal((3000, 16))
    forest = rpforest.Forest(np.arange(3000), x, 20)
    q = np.append(x[7] / np.linalg.norm(x[7]), 0.0)
    rows, near = forest.candidates(q, 20, 0.25)
    held, limit = set(), sorted(near)[-21]
    for cost, leaf in forest.leaves_near(q):
        if cost > 0.25 * (2 - 2 * limit) / 16:
            break
        held |= set(forest.leaves[leaf].tolist()) - {3000}
    assert held <= set(rows.tolist()) and len(rows) == len(set(rows.tolist()))
    costs = [c for c, _ in forest.leaves_near(q)]
    assert costs == sorted(costs) and len(costs) == 16 * 2**forest.depth
    assert measured(x, reach=float("inf")) == (1.0, 1.0)


def test_lengths_of_vectors_from_tiny_to_huge():
    r = np.random.default_rng(5)
    x = r.standard_normal((500, 8)) * 10.0 ** r.integers(-150, 150, (500, 1))
    forest = rpforest.Forest(np.arange(500), x, 20)
    for q in range(0, 500, 25):
        ids, score, _ = forest.search(q, x[q], 20)
        assert len(set(ids)) == 20 and np.isfinite(score).all() and (np.diff(score) <= 0).all()


def test_odd_vectors_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "SHARD_ROWS", 16)
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (140, []), (None, [1.0, 1.0]), (160, [1.0, 2.0, 3.0]), (180, [-1.0, 0.5])]
    rows += [(i, [0.5, 0.5]) for i in range(1, 40) if i != 20] + [(3, [0.5, 0.5]), (20, [1.0, 0.0]), (180, [2.0, 2.0]), (201, [-4.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, kind int")
    got = found(rpforest.nearest(df, df.where("vec_id % 20 = 0")))
    want = {q: v for q, v in brute(rows).items() if v}
    for q in (20,):
        assert got[q] == want[q]
    assert set(got) == {20, 180} and [i for i, _ in got[20]][:2] == [180, 1]
    assert rpforest.nearest(df.where("false"), df).count() == 0 and rpforest.nearest(df, df.where("false")).count() == 0
