"""Exact search against brute force: random and clustered vectors, ties, odd rows, large integers."""

import numpy as np
import pytest

from attestlake.llm import balltree


def brute(rows, k=5, every=50):
    fine = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    fine = [(i, v) for i, v in fine if sum(x * x for x in v) < 1 << 62]
    out = {}
    for q, x in fine:
        if q % every == 0:
            out.setdefault(q, []).extend((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in fine if i != q and len(x) == len(y))
    return sorted((q, n + 1, i, -s) for q, v in out.items() for n, (s, i) in enumerate(sorted(v)[:k]))


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("clusters", [0, 6])
def test_against_brute_force(spark, clusters):
    rng = np.random.default_rng(clusters)
    x = rng.standard_normal((900, 8))
    if clusters:
        x = 0.05 * x + 6 * rng.standard_normal((clusters, 8))[rng.integers(0, clusters, 900)]
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    for size in (None, 100):
        assert found(balltree.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=size)) == brute(rows)


def test_clusters_are_not_all_met():
    """Bounds and the kth score from elsewhere leave leaves closed."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * (0.1 * rng.standard_normal((4096, 16)) + 4 * rng.standard_normal((16, 16))[np.arange(4096) % 16]))
    tree, opened = balltree.BallTree(np.arange(4096), x, 5), []
    plain = tree._open
    tree._open = lambda leaf, who, *rest: (opened.extend([leaf] * len(who)), plain(leaf, who, *rest))
    q = x[:64]
    who, ids, score = tree.search(np.arange(64), q, np.full(64, balltree.LOWEST), 5)
    for n in range(64):
        s = (x @ q[n]).astype(np.int64)
        s[n] = balltree.LOWEST
        best = np.lexsort((np.arange(4096), ~s))[:5]
        assert ids[who == n].tolist() == best.tolist() and score[who == n].tolist() == s[best].tolist()
    assert len(opened) < 0.5 * 64 * len(tree.leaves)
    held = len(opened)
    kth = np.array([score[who == n].min() for n in range(64)])
    again = tree.search(np.arange(64), q, kth, 5)
    assert all((a == b).all() for a, b in zip(again, (who, ids, score), strict=True)) and len(opened) - held <= held


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (300, []), (7, []), (None, [1.0, 1.0]), (350, [1.0, 2.0, 3.0]), (0, [1.0, 0.0]), (0, [-1.0, 0.5])]
    rows += [(i, [0.5, -0.5]) for i in range(1, 40)] + [(3, [0.5, -0.5]), (400, [3e30, 1.0]), (401, [8e6, 1.0]), (450, [7e6, 3.0]), (402, [-1e-9, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, dim int")
    for size in (None, 7):
        assert found(balltree.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=size)) == brute(rows)
    assert balltree.nearest(df.where("false"), df).count() == 0 and balltree.nearest(df, df.where("false")).count() == 0


def test_one_vector_fills_many_shards(spark):
    rows = [(i, [1.0, 1.0]) for i in range(600)] + [(i, [0.5, i / 100]) for i in range(600, 700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(balltree.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=50)) == brute(rows)
