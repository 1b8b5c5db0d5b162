"""Relational operators: scopes, joins on computed or latest rows, folds, rank fusion, upserts, deletes.

All are compositions of DataFrame operations. None collects; joins are equi-joins that Spark plans by size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERIFIED, REFUSED, ALTERED = "verified", "could_not_check", "altered"


def read(df_or_spark, sf_dir: str, name: str) -> DataFrame:
    return df_or_spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- filters -------------------------------------------------------------------------------------------------------


def scope_filter(df: DataFrame, equal: dict[str, object] | None = None, within: dict[str, Sequence | None] | None = None) -> DataFrame:
    """Conjunction of column = value and column IN list. An absent list is no filter, an empty list lets nothing pass."""
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, values in (within or {}).items():
        if values is not None:
            df = df.where(F.col(name).isin(list(values))) if values else df.where(F.lit(False))
    return df


def or_default(col: Column, default: str = "General") -> Column:
    """Blank and null names are the default one."""
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit(default))


def is_due(due: Column, today: Column) -> Column:
    return due.isNull() | (due <= today)


def exploded(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """keep and a row for each element. An inner explode of a costly array has it computed twice, once for a filter on its size."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


# --- joins ---------------------------------------------------------------------------------------------------------


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of greatest order per key, by a partial aggregate instead of a window: no sort, no hot task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def incident_edges(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """node, neighbour for edges in either direction at the given nodes; both directions are equi-joined, so no OR join."""
    both = edges.select(F.col(source).alias("node"), F.col(target).alias("neighbour")).union(edges.select(F.col(target), F.col(source)))
    return both.distinct().join(nodes, "node", "left_semi")


def induced_edges(edges: DataFrame, nodes: DataFrame, key: str, source: str = "source", target: str = "target") -> DataFrame:
    """Edges with both ends in nodes."""
    for end in (source, target):
        edges = edges.join(nodes.select(F.col(key).alias(end)).distinct(), end, "left_semi")
    return edges


def rank_fusion(arms: Sequence[DataFrame], key: Sequence[str], by: str, k: int = 60) -> DataFrame:
    """Sum over arms of 1 / (k + rank): a union and one aggregate, cheaper than outer joins. Arms have key, by and rank."""
    tagged = [a.select(*key, F.col(by), F.col("rank"), F.lit(i).alias("arm")) for i, a in enumerate(arms)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    return union.groupBy(*key, by).agg(
        F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("arm")).alias("arms"), F.min(F.struct("arm", "rank")).alias("first")
    )


def topk_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """row_number <= k; Spark limits groups before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


# --- folds ---------------------------------------------------------------------------------------------------------


def honesty_rank(state: Column) -> Column:
    return F.when(state == ALTERED, 2).when(state == VERIFIED, 0).otherwise(1)


def honesty_state(rank: Column) -> Column:
    """The state of the greatest rank; none at all is a refusal."""
    r = F.coalesce(rank, F.lit(1))
    return F.when(r == 2, ALTERED).when(r == 0, VERIFIED).otherwise(REFUSED)


def honesty_fold(df: DataFrame, keys: Sequence[str], state: str = "state") -> DataFrame:
    """altered over could_not_check over verified. A maximum, so it is aggregated before the shuffle."""
    return df.groupBy(*keys).agg(honesty_state(F.max(honesty_rank(F.col(state)))).alias(state))


def min_max(value: str, keys: Sequence[str]) -> Column:
    """Min-max normalised over the keys' rows; a constant list gives 1.0."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi - lo <= 0, F.lit(1.0)).otherwise((F.col(value) - lo) / (hi - lo))


def duplicate_clusters(docs: DataFrame, hash_col: str, date_col: str, key: str) -> DataFrame:
    """hash, key, canonical key (oldest, null dates last, then least key) and role of documents whose hash repeats.

    The survivor is found by an aggregate and joined back, so a hash that a third of all rows share is split by AQE.
    """
    best = docs.groupBy(hash_col).agg(F.min(F.struct(F.col(date_col).isNull().alias("n"), F.col(date_col).alias("d"), F.col(key).alias("k"))).alias("b"), F.count("*").alias("copies"))
    best = best.where("copies > 1").select(hash_col, F.col("b.k").alias("canonical"), "copies")
    return docs.join(best, hash_col).select(hash_col, key, "canonical", "copies", F.when(F.col(key) == F.col("canonical"), "keep").otherwise("remove").alias("role"))


# --- sinks ---------------------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new replaces old rows of equal key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old, and the rows of new whose key is not there; one row of new per key."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def upsert_unsealed(old: DataFrame, new: DataFrame, key: str, body: str, sealed: str) -> DataFrame:
    """key, body, sealed, outcome: new replaces old but where old is sealed; sealing it again changes nothing, taking the seal off is refused."""
    o, n = old.select(key, F.struct(body, sealed).alias("o")), new.select(key, F.struct(body, sealed).alias("n"))
    was, will = F.coalesce(F.col(f"o.{sealed}"), F.lit(False)), F.coalesce(F.col(f"n.{sealed}"), F.lit(False))
    keeps = was | F.col("n").isNull()
    outcome = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(was & will, "unchanged").when(was, "refused").otherwise("updated")
    return o.join(n, key, "full").select(key, F.when(keeps, F.col(f"o.{body}")).otherwise(F.col(f"n.{body}")).alias(body), (was | will).alias(sealed), outcome.alias("outcome"))


def joined_spans(df: DataFrame, keys: Sequence[str], start: str, end: str, order: str, gap: int) -> DataFrame:
    """keys, piece, n, start, end: spans that begin at most gap after all before them have ended are one piece."""
    w = Window.partitionBy(*keys).orderBy(start, order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("new", F.when(F.col(start) <= before + gap, 0).otherwise(1))
    pieces = new.withColumn("piece", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy(*keys, "piece").agg(F.count("*").alias("n"), F.min(start).alias(start), F.max(end).alias(end))


def upsert_latest(old: DataFrame, new: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Key-value table: the value written last."""
    return old.unionByName(new).groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def cascade_delete(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """parent and every child table without the rows of the keys that go."""
    out = {"parent": parent.join(gone, key, "left_anti")}
    for name, (df, fk) in children.items():
        out[name] = df.join(gone.select(F.col(key).alias(fk)), fk, "left_anti")
    return out
