"""Streams of events: cursor reads, dedupe by content on ingest, progress of jobs, verdicts by claim.

All write by foreachBatch to Parquet with the batch number as a folder, so a batch that runs again after a failure
replaces what it wrote; where a run stands is in the stream's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def after_cursor(rows: DataFrame, id_: str, after: int, limit: int) -> DataFrame:
    """Rows of id greater than after, in order, at most limit of them: a page of an append-only log."""
    return rows.where(F.col(id_) > after).orderBy(id_).limit(limit)


def write_batches(rows: DataFrame, out: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, seconds: int | None = None, mode: str = "append") -> StreamingQuery:
    """Starts a query that writes change(batch) to out/batch=N. seconds: the interval; None: all there is now, then it ends."""

    def put(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def new_content(stream: DataFrame, text: str, at: str, within: str = "1 day") -> DataFrame:
    """The first row of each content hash, remembered for `within` of event time. Null text is one content."""
    hashed = stream.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return hashed.withWatermark(at, within).dropDuplicatesWithinWatermark(["content_hash"])


def current_state(transitions: DataFrame, job: str, seq: str, state: str) -> DataFrame:
    """job, state, n: each job's last state. A maximum per job, so it holds for batches and streams (output mode update)."""
    return transitions.groupBy(job).agg(F.max_by(state, seq).alias(state), F.count("*").alias("n"))


def unfinished(transitions: DataFrame, job: str, seq: str, state: str, open_states: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """job, seq: the jobs whose last state is an open one, which a start has to resume, and where they stand."""
    last = transitions.groupBy(job).agg(F.max_by(state, seq).alias("last"), F.max(seq).alias(seq))
    return last.where(F.col("last").isin(*open_states)).select(job, seq)


def mastery(stream: DataFrame, key: str, seq: str, kind: str, steps: dict[str, float], other: float, start: float = 0.5) -> DataFrame:
    """key, mastery, n: each key's mastery after every batch (output mode update).

    An event adds its kind's step (other for unknown kinds), clamped to 0..1 and rounded to three places at once, so order
    counts: by seq within a batch, batches as they come. Per key the state is two numbers.
    """

    def fold(k, frames, state):
        at, n = state.get if state.exists else (start, 0)
        rows = pd.concat([f[[seq, kind]] for f in frames]).sort_values(seq, kind="stable")
        for e in rows[kind]:
            at = round(min(1.0, max(0.0, at + steps.get(e, other))), 3)
        state.update((at, n + len(rows)))
        yield pd.DataFrame({key: [k[0]], "mastery": [at], "n": [n + len(rows)]})

    out = StructType([stream.schema[key], StructField("mastery", DoubleType()), StructField("n", LongType())])
    return stream.select(key, seq, kind).groupBy(key).applyInPandasWithState(fold, out, "at double, n long", "update", "NoTimeout")


def verdicts(claims: DataFrame, found: DataFrame, claim_id: str, verdict: str) -> DataFrame:
    """One verdict for each claim; a claim without one could not be checked."""
    best = found.groupBy(claim_id).agg(F.min(verdict).alias(verdict))
    return claims.join(best, claim_id, "left").withColumn(verdict, F.coalesce(verdict, F.lit("could_not_check")))
