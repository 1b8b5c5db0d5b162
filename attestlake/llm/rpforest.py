"""Approximate nearest neighbours by forests of random-projection trees.

Rows are dealt into shards of about SHARD_ROWS by a hash of their id, so a common vector or label meets no limit in any
shard. A task indexes one shard: TREES trees that split at medians of random projections (one direction a level), down
to leaves of about LEAF rows. A further component lifts all vectors to the greatest norm, so that the largest inner
product is the least distance, whatever the norms. Queries stream past the index. One priority queue over all trees
holds the branches a query hasn't taken, by the sum of squared distances to the cuts on whose far side they lie; the
next leaf opened is the nearest of any tree. All rows of the opened leaves are candidates and are reranked by the inner
product of the original vectors in double precision; the best k of all shards are merged.

A query stops when the next branch lies farther than REACH times what a random direction shows of the distance to its
kth best candidate (that squared distance over the dimension). So vectors in clusters open few leaves and random ones
many: random vectors of 64 dimensions, the hardest case, open leaves with more than half of a shard's rows for a recall
above 0.9. The rule holds for each shard and has no size in it, so recall doesn't fall as the table grows.

Equal vectors of a shard are indexed once and stand for their k + 1 least ids, which no result can exceed. Vectors that
are null, zero or hold null or non-finite components, and null ids, take no part; vectors of another length are never
candidates of a query. Rows that share the query's id aren't its neighbours. Ties go to the smaller id; rows that repeat
id and vector count once. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS, QUERY_ROWS = 8_192, 65_536
#: Leaves that are opened before the kth best candidate is looked at again.
STEP = 16
TREES, LEAF, REACH = 16, 64, 0.25


class Forest:
    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.x, inverse = np.unique(x, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        by = np.argsort(inverse, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(self.x)))))
        self.ids = [np.unique(ids[by[a:b]])[: k + 1] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        # Scaled and lifted: all rows of y have the norm 1.
        y = self.x / np.abs(self.x).max()
        norms = (y * y).sum(1)
        self.y = np.column_stack([y, np.sqrt(norms.max() - norms)]) / np.sqrt(norms.max())
        n, dim = self.y.shape
        self.depth = d = max(0, int(np.ceil(np.log2(max(n / leaf, 1)))))
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((trees, d, dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True) if d else 1
        size = -(-n // 2**d)
        cuts = np.zeros((trees, 2**d - 1))
        self.leaves = np.zeros((trees, 2**d, size), np.int32)
        for t in range(trees):
            # Row n fills the halves up; it lies to the right of every cut.
            along = np.vstack([self.y @ self.directions[t].T, np.full((1, d), np.inf)])
            rows = rng.permutation(np.minimum(np.arange(size * 2**d), n)).reshape(1, -1)
            for level in range(d):
                half = rows.shape[1] // 2
                p = along[rows, level]
                o = np.argpartition(p, half, axis=1)
                p, rows = np.take_along_axis(p, o, 1), np.take_along_axis(rows, o, 1)
                low, high = p[:, :half], p[:, half:].min(1)
                low = np.where(np.isinf(low), -1e300, low).max(1)
                cuts[t, 2**level - 1 : 2 ** (level + 1) - 1] = np.where(np.isinf(high), low, low / 2 + np.where(np.isinf(high), 0, high) / 2)
                rows = rows.reshape(-1, half)
            self.leaves[t] = rows
        self.cuts, self.leaves = cuts.tolist(), self.leaves.reshape(-1, size)

    def leaves_near(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """All leaves with their costs, nearest first, as the queue over all trees gives them. q is a unit vector like the rows of y."""
        d, first = self.depth, 2**self.depth - 1
        along = (self.directions @ q).tolist()
        queue = [(0.0, t, 0, 0) for t in range(len(self.cuts))]
        while queue:
            cost, t, node, level = heappop(queue)
            p, cuts = along[t], self.cuts[t]
            while level < d:
                margin = p[level] - cuts[node]
                near, level = 2 * node + 1 + (margin > 0), level + 1
                heappush(queue, (cost + margin * margin, t, 4 * node + 3 - near, level))
                node = near
            yield cost, t * 2**d + node - first

    def candidates(self, q: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the opened leaves and their inner products with q, a unit vector like the rows of y."""
        n, dim = self.y.shape
        seen = np.zeros(n + 1, bool)
        rows, near, best, limit, opened = [], [], np.zeros(0), np.inf, []
        leaves = self.leaves_near(q)
        while True:
            for cost, leaf in leaves:
                if cost > limit:
                    leaves = iter(())
                    break
                opened.append(leaf)
                if len(opened) == STEP:
                    break
            if not opened:
                return np.concatenate(rows), np.concatenate(near)
            new = self.leaves[opened].ravel()
            new = np.unique(new[~seen[new]])
            new = new[new < n]
            seen[new] = True
            opened = []
            rows.append(new)
            near.append(self.y[new] @ q)
            best = np.concatenate([best, near[-1]])
            if len(best) > k + 1:  # the query itself may be one of them
                best = np.partition(best, -(k + 1))[-(k + 1) :]
                limit = reach * max(0.0, 2 - 2 * best[0]) / (dim - 1)
            if seen[:n].all():
                return np.concatenate(rows), np.concatenate(near)

    def search(self, qid: int, q: np.ndarray, k: int, reach: float = REACH) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the at most k best in the opened leaves, and the number of vectors that these hold."""
        unit = q / np.abs(q).max()
        rows, near = self.candidates(np.append(unit / np.sqrt((unit * unit).sum()), 0.0), k, reach)
        reranked = len(rows)
        if reranked > k + 1:  # what rounding can't bring among the best needs no second look
            rows = rows[near >= np.partition(near, -(k + 1))[-(k + 1)] - 1e-9]
        exact = (self.x[rows] * q).sum(1)  # row by row: the same digits, whatever else is reranked
        ids = np.concatenate([self.ids[r] for r in rows])
        score = np.repeat(exact, [len(self.ids[r]) for r in rows])
        other = ids != qid
        ids, score = ids[other], score[other]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best], reranked


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, reach: float = REACH, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries its k nearest rows of vectors. Both have vec_id, embedding."""

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))

    rows, asked = valid(vectors), valid(queries)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    groups = max(1, -(-asked.count() // QUERY_ROWS))

    def dealt(col: str, seed: int, n: int) -> Column:
        return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    indexed = rows.select(F.lit(0).alias("kind"), "*", dealt("vec_id", 42, shards).alias("shard"), each(groups).alias("group"))
    asking = asked.select(F.lit(1).alias("kind"), "*", each(shards).alias("shard"), dealt("vec_id", 3, groups).alias("group"))
    both = indexed.unionByName(asking).select((F.col("shard") * groups + F.col("group")).alias("task"), F.size("embedding").alias("dim"), "kind", "vec_id", "embedding")
    parts = both.repartitionById(shards * groups, "task").sortWithinPartitions("dim", "kind").drop("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, forest, ids, xs = None, None, [], []
        for batch in batches:
            dim, kind, vec_id = (np.asarray(batch.column(i)) for i in range(3))
            if not len(dim):
                continue
            cut = np.flatnonzero((dim[1:] != dim[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(dim)], strict=True):
                if dim[a] != length:
                    length, forest, ids, xs = dim[a], None, [], []
                x = np.asarray(batch.column(3)[a:b].flatten()).reshape(b - a, length)
                if kind[a] == 0:
                    ids.append(vec_id[a:b]), xs.append(x)
                    continue
                if not ids:
                    continue  # no row has this length in this shard
                if forest is None:
                    forest = Forest(np.concatenate(ids), np.concatenate(xs), k, trees, leaf)
                    xs = []
                found = [forest.search(int(i), q, k, reach) for i, q in zip(vec_id[a:b], x, strict=True)]
                n = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(vec_id[a:b], n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    found = parts.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A query id that repeats with other vectors may meet a row twice; its best score stays.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The same with every leaf opened, to measure recall."""
    return nearest(vectors, queries, k, reach=float("inf"))
