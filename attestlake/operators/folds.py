"""Ordered folds as aggregate expressions, BM25 top-k and diverse top-k.

A fold's state stays inside one row, so it runs where the row is: no Python, and one shuffle at most to gather a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestlake.operators import relational as R

#: BM25's usual k1 and b.
K1, B = 1.2, 0.75


def size_bounded(blocks: str | Column, limit: int, gap: str = "\n\n") -> Column:
    """Chunks of an ordered array of (mark, text): a block joins the open chunk unless its mark differs or limit would be passed.

    Blank texts are left out; a block over the limit is a chunk of its own; a null array gives null.
    """
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(None).cast("string").alias("mark"))

    def step(acc: Column, x: Column) -> Column:
        text = F.trim(x["text"])
        fits = acc["mark"].eqNullSafe(x["mark"]) & (F.length(acc["open"]) + F.length(text) + len(gap) <= limit)
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(gap), text).alias("open"), acc["mark"].alias("mark"))
        begun = F.struct(F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), text.alias("open"), x["mark"].alias("mark"))
        return F.when(F.coalesce(text, F.lit("")) == "", acc).when((acc["open"] != "") & fits, joined).otherwise(begun)

    return F.aggregate(blocks, zero, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def marker_run(marks: str | Column) -> Column:
    """Length of the run a, b, c, ... that an ordered array of single letters begins with; other letters are passed over."""
    letters = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"])
    return F.aggregate(marks, F.lit(0), lambda n, m: F.when(F.get(letters, n) == m, n + 1).otherwise(n))


def _terms(df: DataFrame, id_: str, text: str) -> DataFrame:
    return df.where(F.col(id_).isNotNull()).select(id_, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str, k: int) -> DataFrame:
    """query, rank, document, score: the k best documents of each query, ties to the lesser id.

    Documents meet queries on the terms that queries hold, after their counts are aggregated; statistics of a term are
    counted over all documents.
    """
    own = _terms(docs, doc_id, text)
    terms = _terms(queries, query_id, text).select(query_id, F.explode(F.array_distinct("w")).alias("term"))
    n = own.agg(F.count("*").alias("docs"), F.avg(F.size("w")).alias("mean"))
    tf = own.select(doc_id, F.size("w").alias("len"), F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    tf = tf.groupBy(doc_id, "len", "term").agg(F.count("*").alias("f"))
    df = tf.groupBy("term").agg(F.count("*").alias("d"))
    part = F.log(1 + (F.col("docs") - F.col("d") + 0.5) / (F.col("d") + 0.5)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(n)).select("term", doc_id, part.alias("part"))  # n is one row
    scored = terms.join(weighed, "term").groupBy(query_id, doc_id).agg(F.round(F.sum("part"), 6).alias("score"))
    return R.topk_per_key(scored, [query_id], [F.desc("score"), F.col(doc_id)], k).select(query_id, "rank", doc_id, "score")


def diverse(df: DataFrame, key: str, label: str, score: str, k: int, most: float = 0.6) -> DataFrame:
    """key, rank, label, score: greedily the k best labels whose token Jaccard with each one taken is below most.

    Equal labels are one candidate, of their best score; ties go to the lesser label.
    """
    best = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.max(score).alias("s"))
    rows = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("minus"), F.col(label).alias("label")))).alias("rows"))
    item = "struct<label:string,score:double,words:array<string>>"

    def step(acc: Column, x: Column) -> Column:
        w = F.array_distinct(F.split(F.lower(x["label"]), " "))
        near = F.exists(acc, lambda y: F.size(F.array_intersect(y["words"], w)) / F.size(F.array_union(y["words"], w)) >= most)
        taken = F.struct(x["label"].alias("label"), (-x["minus"]).cast("double").alias("score"), w.alias("words"))
        return F.when((F.size(acc) >= k) | near, acc).otherwise(F.concat(acc, F.array(taken)))

    picked = rows.select(key, F.posexplode(F.aggregate("rows", F.array().cast(f"array<{item}>"), step)).alias("at", "x"))
    return picked.select(key, (F.col("at") + 1).alias("rank"), "x.label", "x.score")
