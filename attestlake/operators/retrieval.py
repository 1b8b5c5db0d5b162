"""Ranking of texts for queries: BM25 over several columns, lexical grounding, fallbacks by scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestlake.functions import text as X

K1, B = 1.2, 0.75


def _words(c: Column) -> Column:
    return X.matches(F.lower(F.coalesce(c, F.lit(""))), "[a-z]{3,}")


def bm25(docs: DataFrame, id_: str, columns: Sequence[str], queries: DataFrame, query_id: str, k: int) -> DataFrame:
    """query_id, id_, score, rank: the k best documents by BM25 for the distinct words of each query (column words).

    The columns count as one text. A word in more than half of all documents keeps a weight of 1e-6. Postings hold only
    the words that some query asks for, counted before the shuffle; scores meet their query by word.
    """
    terms = queries.select(query_id, F.explode(F.array_distinct("words")).alias("w"))
    tokens = docs.select(id_, F.flatten(F.array(*[_words(F.col(c)) for c in columns])).alias("t")).withColumn("len", F.size("t"))
    stats = tokens.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean"))  # one row
    tf = tokens.select(id_, "len", F.explode("t").alias("w")).join(terms.select("w").distinct(), "w", "left_semi").groupBy("w", id_, "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df")).join(F.broadcast(stats)).withColumn("idf", F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    one = tf.join(df, "w").select("w", id_, (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))).alias("s"))
    scored = one.join(terms, "w").groupBy(query_id, id_).agg(F.round(F.sum("s"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_)).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def routed_types(queries: DataFrame, query_id: str, words: str, keywords: DataFrame, base: Sequence[str]) -> DataFrame:
    """query_id, types (sorted): the base types and those whose keyword is a word of the query."""
    hit = queries.select(query_id, F.explode(words).alias("keyword")).join(keywords, "keyword").groupBy(query_id).agg(F.collect_set("type").alias("t"))
    own = F.array(*map(F.lit, base))
    return queries.select(query_id).join(hit, query_id, "left").select(query_id, F.array_sort(F.array_union(own, F.coalesce("t", own))).alias("types"))


def first_level(levels: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of the first level that has any for their key; columns of all levels are the same."""
    tagged = None
    for i, level in enumerate(levels):
        x = level.withColumn("level", F.lit(i))
        tagged = x if tagged is None else tagged.unionByName(x)
    best = tagged.groupBy(key).agg(F.min("level").alias("level"))
    return tagged.join(best, [key, "level"], "left_semi")


def evaluation(rows: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Grp, cases, hits, hit_rate, citation_precision, citation_recall, quote_validity, drop_rate, repair_rate.

    rows: case, rank, expected, cited, dropped, repaired, valid, one for each source that a case retrieved. A case hits if an
    expected source is among its first k. Precision and recall are means over cases (0 where nothing was cited or expected);
    the rates are over all attempts. cases: case, grp; cases without rows count as misses.
    """
    n = lambda c: F.count_if(c)
    per = rows.groupBy("case").agg(
        F.count("*").alias("tried"), F.max(F.col("expected") & (F.col("rank") <= k)).alias("hit"), n("expected").alias("wanted"), n("cited").alias("cited"), n(F.col("cited") & F.col("expected")).alias("both"), n("dropped").alias("dropped"),
        n("repaired").alias("repaired"), n("valid").alias("valid"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    over = lambda c: F.round(F.sum(c) / F.sum("tried"), 4)
    x = cases.join(per, "case", "left").na.fill(0).withColumn("hit", F.coalesce("hit", F.lit(False)))
    return x.groupBy("grp").agg(
        F.count("*").alias("cases"), n("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"), F.round(F.avg(share("both", "cited")), 4).alias("citation_precision"),
        F.round(F.avg(share("both", "wanted")), 4).alias("citation_recall"), over("valid").alias("quote_validity"), over("dropped").alias("drop_rate"), over("repaired").alias("repair_rate"),
    )
