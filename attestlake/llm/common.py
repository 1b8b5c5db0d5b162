"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes 0-9, a-z and everything outside ASCII stay, A-Z are lower-cased, all else becomes a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *made: str) -> DataFrame:
    """df without columns of these names (in any case): what an operator makes takes their place."""
    return df.drop(*[c for c in df.columns if c.lower() in made])


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of 0-9, a-z and non-ASCII bytes. None has none."""
    return text.translate(WORD_BYTES).split() if text else []


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put in front until no column of df is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where none is set, a local one serves a local session; on a cluster that is an error, as executors don't see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not at and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = at or tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
    return at or spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables of one job, written once to the shared folder: lost executors cost no recomputation, lineage ends here."""

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, {}
        self.at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        Scratch.live.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{len(self.tables)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        for path, table in self.tables.items():
            if any(table is t for t in tables):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever Spark's own paths may lie."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Removes what jobs have left in the shared folder since Scratch.live had that length; their results can't be read after that."""
    while len(Scratch.live) > since:
        delete(spark, Scratch.live.pop().at)


def row_hashes(docs: DataFrame, k1: str = "k1", k2: str = "k2") -> list[Column]:
    """Two hashes of doc_id and text, which find a row again."""
    own = [F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))]
    return [F.xxhash64(*own).alias(k1), F.xxhash64(F.lit(1), *reversed(own)).alias(k2)]


def binary_lists(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as bytes objects, without decoding."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """Runs of equal key in a stream that is sorted by it, as column lists."""
    held: dict[str, list] | None = None
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        keys = cols[key]
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                part = {n: c[start:i] for n, c in cols.items()}
                if held is not None and held[key][0] == part[key][0]:
                    for n in held:
                        held[n].extend(part[n])
                else:
                    if held is not None:
                        yield held
                    held = part
                start = i
    if held is not None:
        yield held
