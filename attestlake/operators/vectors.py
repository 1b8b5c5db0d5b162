"""Exact nearest rows by distance, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and queries that a task holds against each other.
ROWS, QUERIES = 65_536, 4_096
#: Queries of one matrix product (32 MB of squares for ROWS rows).
STEP = 64


def close(x: np.ndarray, asked: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of asked the rows of x that can be among its k nearest: one matrix product for STEP rows at a time,
    and all rows within its rounding error of the kth. Where lengths overflow that is every row."""
    norms, length = (x * x).sum(1), (asked * asked).sum(1)
    for a in range(0, len(asked), STEP):
        with np.errstate(all="ignore"):
            squares = norms - 2 * (asked[a : a + STEP] @ x.T) + length[a : a + STEP, None]
        for d, own in zip(squares, length[a : a + STEP], strict=True):
            slack = 1e-12 * x.shape[1] * (norms.max() + own)
            if len(d) <= k or not np.isfinite(d).all() or not np.isfinite(slack):
                yield np.arange(len(d))
            else:
                yield np.flatnonzero(d <= np.partition(d, k - 1)[k - 1] + slack)


def nearest(rows: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, rows_per_task: int = ROWS, queries_per_task: int = QUERIES) -> DataFrame:
    """query_id, id_, distance, rank: the k rows of least L2 distance of each query but itself, ties to the smaller id.

    Rows and queries are dealt into blocks, every pair of blocks is one task, and only k rows a query leave it. Null
    vectors take no part; rows of another length are skipped.
    """
    v = lambda df: df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    own, asked = v(rows), v(queries)
    a, b = (max(1, -(-df.count() // n)) for df, n in ((own, rows_per_task), (asked, queries_per_task)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.select(F.lit(0).alias("side"), "id", "v", block(a).alias("i"), every(b).alias("j"))
    right = asked.select(F.lit(1).alias("side"), "id", "v", every(a).alias("i"), block(b).alias("j"))
    dealt = left.unionByName(right).select((F.col("i") * b + F.col("j")).alias("task"), F.size("v").alias("dim"), "side", "id", "v")
    dealt = dealt.repartitionById(a * b, "task").sortWithinPartitions("dim", "side").drop("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        length, ids, x = None, None, None
        for batch in batches:
            dim, side, key = (np.asarray(batch.column(c)) for c in range(3))
            for d in np.unique(dim):
                for s in (0, 1):
                    at = np.flatnonzero((dim == d) & (side == s))
                    if not len(at):
                        continue
                    if d != length:
                        length, held, ids = d, [], None
                    m = np.array(batch.column(3).take(pa.array(at)).flatten(), np.float64).reshape(len(at), d)
                    if s == 0:
                        held.append((key[at], m))
                        continue
                    if ids is None and held:
                        ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    for q, y, rows in zip(key[at], m, close(x, m, k + 1), strict=True) if held else ():
                        rows = rows[ids[rows] != q]
                        dist = np.sqrt(((x[rows] - y) ** 2).sum(1))
                        order = np.lexsort((ids[rows], dist))[:k]
                        order = order[np.isfinite(dist[order])]
                        best, dist = rows[order], dist[order]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(ids[best]), pa.array(dist)], ["query_id", "id", "distance"])

    found = dealt.mapInArrow(run, "query_id long, id long, distance double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("long")
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_), "distance", "rank")
