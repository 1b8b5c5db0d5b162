"""A training corpus from `documents`, in five stages.

Each stage works on all that the one before it kept, and its decisions take effect: rejected documents go, lines that
ten documents share go, one document of each near-duplicate class stays, contaminated documents go, and the rest
becomes token ids. Each stage's rows are written as Parquet and read again by the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestlake.llm import bagminhash, bpe, decontam, linededup, quality
from attestlake.llm.common import Scratch, delete, ensure_checkpoint_dir, release, table
from attestlake.llm.queries import TOKENIZER


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, made=("__score", "__predicted")).where("__predicted = 1").drop("__score", "__predicted")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines found in ten or more of them; n_chars follows the text."""
    made = ("__lines", "__dropped", "__sha256")
    out = linededup.dedup_lines(docs, min_docs=10, min_chars=1, made=made).drop(*made)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return bagminhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids."""
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenize),
]

#: Boosted trees, near-duplicate classes and BPE merges are not SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what the next one has read goes."""
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = len(Scratch.live)
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        release(spark, before)
        if last is not None:
            delete(spark, last)
        last = f"{at}/{name}"
    return docs
