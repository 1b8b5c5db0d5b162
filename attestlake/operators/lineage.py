"""Ends the lineage of a DataFrame between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share; a local session without one takes a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed to the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read from there: what several jobs read is made once."""
    at = folder(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def once_per_text(docs: DataFrame, id_: str, text: str, find: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """What find(texts, key, text) gives, with id_ for key: it reads each distinct text once, however many rows hold it.

    find gives rows with the key, from one text each. Null texts give none. The texts are dealt out anew, as few bytes may be much work.
    """
    keyed = docs.where(F.col(text).isNotNull()).select(id_, F.unhex(F.sha2(F.col(text), 256)).alias("text_key"), text)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    found = find(written(keyed.select("text_key", text).distinct().repartition(n)), "text_key", text)
    return keyed.select(id_, "text_key").join(found, "text_key").select(id_, *[c for c in found.columns if c != "text_key"])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files give fewer partitions than there are cores: a table of one small file. Larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
