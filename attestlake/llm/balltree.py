"""Exact top-k search by inner product: ball trees, branch and bound, and a kth score that all shards share.

Vectors become integers, floor(scale * x), so scores are exact. A bounded sample of the vectors (those of least hash) is
halved along its widest directions into at most CELLS cells, whose means are the pivots; every vector lies in the cell of
its nearest pivot, and a cell with more than shard_rows vectors is dealt over several shards by a hash of the id, so one
hot vector or region fills many shards alike. A cell is a ball: its pivot and the largest distance of any of its vectors from it.

Each query first meets one shard of the cell with the greatest upper bound |q| * radius + q * centre. The kth best score
found there goes with the query to all shards of those cells whose bound isn't below it; the others are never met. In a
shard, the rows form a ball tree (halved at medians of the widest direction, LEAF rows in a leaf). Nodes whose bound is
below the query's kth score fall away with all they hold, the leaves that remain are opened by falling bound, and each
opened leaf raises the kth score. Queries that stand at the same leaf are scored in one matrix product. Shards are paired
with blocks of at most QUERY_ROWS queries, so a task holds at most shard_rows + QUERY_ROWS vectors.

The sample decides where rows lie, never what is found. Random vectors have no near and far cells: bounds then cut
nothing, and every query meets every shard, as any exact search would have it.

Defined results: null ids, null vectors, vectors with null or non-finite components and vectors whose integers have a
squared norm of 2^62 or more (their scores may not fit a long) take no part; vectors of another length are never
candidates of a query. Zero vectors and negative scores count. Rows that share the query's id are no candidates; rows
that repeat id and vector count once, an id with several vectors is several candidates, and as a query it has the best
of all pairs. Ties go to the smaller id. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestlake.llm.common import Scratch

SAMPLE_BYTES, SAMPLE_ROWS, CELLS = 1 << 23, 4096, 256
LEAST_SHARD, MOST_SHARD, QUERY_ROWS, LEAF = 1024, 65_536, 16_384, 128
#: Rounding of bounds, relative to the sizes that go into them.
SLACK = 1e-9
LOWEST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, v: integers of the vectors that take part, a row once."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("x", F.transform("x", lambda c: F.floor(c * scale).cast("double")))
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c) < float(1 << 62))
    return rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: c.cast("int")).alias("v"))


def halves(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x cut at the median between two that lie far apart."""
    part = x[rows]
    far = part[np.argmax(((part - part[0]) ** 2).sum(1))]
    along = part @ (far - part[np.argmax(((part - far) ** 2).sum(1))])
    order = np.argpartition(along, len(rows) // 2)
    return rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]


def groups_of(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of x in groups of at most size rows."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) > size:
            todo += halves(x, rows)
        else:
            done.append(rows)
    return done


class BallTree:
    """Nodes level by level, each with centre and radius; node i halves into 2 i and 2 i + 1 of the next level; leaves hold the rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, leaf: int = LEAF) -> None:
        distinct, inverse = np.unique(x, axis=0, return_inverse=True) if x.shape[1] else (x[:1], np.zeros(len(x), np.int64))
        inverse = inverse.ravel()
        by = np.lexsort((ids, inverse))
        same = np.split(ids[by], np.flatnonzero(np.diff(inverse[by])) + 1)
        nodes, self.levels = [np.arange(len(distinct))], []
        while True:
            balls = [(c := distinct[r].mean(0), np.sqrt(((distinct[r] - c) ** 2).sum(1).max())) for r in nodes]
            self.levels.append((np.stack([c for c, _ in balls]), np.array([r for _, r in balls])))
            if max(map(len, nodes)) <= leaf or min(map(len, nodes)) < 2:
                break
            nodes = [half for r in nodes for half in halves(distinct, r)]
        self.leaves = []
        for r in nodes:
            each = [np.unique(same[i])[: k + 1] for i in r]  # the most that equal vectors can bring to a result
            self.leaves.append((np.concatenate(each), np.repeat(distinct[r], list(map(len, each)), 0)))
        self.longest = float(np.sqrt((distinct**2).sum(1).max()))

    def bounds(self, level: int, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product of each query with the rows of its node."""
        centre, radius = self.levels[level][0][node], self.levels[level][1][node]
        length = np.sqrt((q**2).sum(1))
        return (q * centre).sum(1) + length * radius + SLACK * length * (np.sqrt((centre**2).sum(1)) + radius) + 1e-6

    def search(self, own: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of the at most k best rows here for each query, of those that reach its kth score."""
        n, kth = len(q), kth.copy()
        exact = float(np.sqrt((q**2).sum(1).max())) * self.longest < float(1 << 52)  # then a double holds all partial sums
        who, node = np.arange(n), np.zeros(n, np.int64)
        for level in range(len(self.levels)):
            if level:
                who, node = np.repeat(who, 2), (2 * node[:, None] + np.arange(2)).ravel()
            reach = self.bounds(level, q[who], node)
            stays = reach >= kth[who]
            who, node, reach = who[stays], node[stays], reach[stays]
        order = np.lexsort((-reach, who))
        who, node, reach = who[order], node[order], reach[order]
        turn = np.arange(len(who)) - np.searchsorted(who, who)
        ids, score = np.full((n, k), LAST), np.full((n, k), LOWEST)
        for t in range(int(turn.max(initial=-1)) + 1):
            now = np.flatnonzero((turn == t) & (reach >= kth[who]))
            now = now[np.argsort(node[now], kind="stable")]
            for at in np.split(now, np.flatnonzero(np.diff(node[now])) + 1):
                if len(at):
                    self._open(int(node[at[0]]), who[at], own, q, kth, ids, score, exact)
        found = ids < LAST
        return np.nonzero(found)[0], ids[found], score[found]

    def _open(self, leaf: int, who: np.ndarray, own: np.ndarray, q: np.ndarray, kth: np.ndarray, ids: np.ndarray, score: np.ndarray, exact: bool) -> None:
        """Merges the rows of one leaf into the best of the queries that stand at it."""
        row_ids, x = self.leaves[leaf]
        k = ids.shape[1]
        s = (q[who] @ x.T).astype(np.int64) if exact else q[who].astype(np.int64) @ x.T.astype(np.int64)
        i, j = np.nonzero((s >= kth[who][:, None]) & (row_ids[None, :] != own[who][:, None]))
        if not len(i):
            return
        met = np.unique(i)
        whose = np.concatenate([i, np.repeat(met, k)])
        new_ids, new_score = np.concatenate([row_ids[j], ids[who[met]].ravel()]), np.concatenate([s[i, j], score[who[met]].ravel()])
        order = np.lexsort((new_ids, ~new_score, whose))
        whose, new_ids, new_score = whose[order], new_ids[order], new_score[order]
        place = np.arange(len(whose)) - np.searchsorted(whose, whose)
        top = place < k
        ids[who[whose[top]], place[top]], score[who[whose[top]], place[top]] = new_ids[top], new_score[top]
        full = who[met][ids[who[met], k - 1] < LAST]
        kth[full] = np.maximum(kth[full], score[full, k - 1])


def routing(sample: pa.Table, cells: int) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of vectors in the sample: the number of its first cell, and the pivots."""
    dims, out, at = np.asarray(sample.column("dim")), {}, 0
    for dim in np.unique(dims):
        x = np.array(sample.column("v").take(np.flatnonzero(dims == dim)).to_pylist(), np.float64).reshape(int((dims == dim).sum()), dim)
        share = max(1, cells * len(x) // len(dims))
        pivots = np.stack([x[g].mean(0) for g in groups_of(x, -(-len(x) // share))])
        out[int(dim)] = (at, pivots)
        at += len(pivots)
    return out


def routed(rows: DataFrame, pivots: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """rows with cell (that of the nearest pivot; -1 for lengths that the sample lacks) and far, the distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            cell, far = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = batch.column("v").take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), dim)
                first, p = pivots.get(int(dim), (-1, np.zeros((1, dim))))
                near = ((p**2).sum(1) - 2 * (x @ p.T)).argmin(1)
                cell[at], far[at] = first + near, np.sqrt(((x - p[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), pa.array(cell), pa.array(far), batch.column("v")], ["vec_id", "dim", "cell", "far", "v"])

    return rows.select("vec_id", "dim", "v").mapInArrow(run, "vec_id long, dim int, cell int, far double, v array<int>")


def meet(rows: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """qno, query_id, vec_id, score: each query's best in the shards it is sent to. asked: qno, query_id, v, kth and the shard (dim, cell, shard)."""
    key = ["dim", "cell", "shard", "block"]
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qno"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked.select(*key).distinct(), key, "left_semi")
    schema = pa.schema([("qno", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        dim = left.column("dim")[0].as_py()
        x, q = (np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(len(t), dim) for t in (left, right))
        qno, own = right.column("qno").to_numpy(), right.column("query_id").to_numpy()
        who, ids, score = BallTree(left.column("vec_id").to_numpy(), x, k).search(own, q, right.column("kth").to_numpy(), k)
        return pa.table([qno[who], own[who], ids, score], schema=schema)

    left, right = rows.select(*key, "vec_id", "v"), asked.select(*key, "qno", "query_id", "kth", "v")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "qno long, query_id long, vec_id long, score long")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries its k best rows of vectors. Both have vec_id, embedding."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = prepared(vectors, scale)
    n, widest = rows.agg(F.count("*"), F.max("dim")).first()
    shard_rows = shard_rows or int(np.clip(-(-n // (4 * spark.sparkContext.defaultParallelism)), LEAST_SHARD, MOST_SHARD))
    some = int(np.clip(SAMPLE_BYTES // (4 * max(widest or 1, 1)), 1, SAMPLE_ROWS))
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(some).select("dim", "v").toArrow()
    pivots = routing(sample, int(np.clip(n // shard_rows, 1, CELLS)))
    rows = scratch.save(routed(rows, pivots))
    centres = spark.createDataFrame([(first + i, p) for first, ps in pivots.values() for i, p in enumerate(ps.tolist())], "cell int, centre array<double>")
    cells = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).join(centres, "cell", "left")
    cells = scratch.save(cells.select("dim", "cell", "radius", "centre", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards")))
    rows = rows.join(cells.select("dim", "cell", "shards"), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    asked = scratch.save(prepared(queries, scale).distinct().select(F.monotonically_increasing_id().alias("qno"), F.col("vec_id").alias("query_id"), "dim", "v"))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    dot = F.coalesce(F.aggregate(F.zip_with("v", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c), F.lit(0.0))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c))
    size = F.sqrt(F.coalesce(F.aggregate("centre", F.lit(0.0), lambda s, c: s + c * c), F.lit(0.0)))
    reach = scratch.save(asked.join(cells, "dim").select("qno", "dim", "cell", "shards", (dot + length * F.col("radius") + SLACK * length * (size + F.col("radius")) + 1e-6).alias("reach")))
    best = reach.groupBy("qno").agg(F.max_by(F.struct("cell", "shards"), F.struct("reach", "cell")).alias("c")).select("qno", "c.*")
    first = scratch.save(best.select("qno", "cell", F.pmod(F.xxhash64("qno"), F.col("shards")).cast("int").alias("shard")))
    found = scratch.save(meet(rows, asked.join(first, "qno").withColumn("kth", F.lit(int(LOWEST))), blocks, k))
    kth = found.groupBy("qno").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("qno", "kth")
    later = reach.join(kth, "qno", "left").withColumn("kth", F.coalesce("kth", F.lit(int(LOWEST)))).where("reach >= kth")
    later = later.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(first, ["qno", "cell", "shard"], "left_anti")
    later = asked.join(later.select("qno", "cell", "shard", "kth"), "qno")
    found = found.unionByName(meet(rows, later, blocks, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
