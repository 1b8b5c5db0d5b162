"""Verification of claims against sources on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestlake.functions import anchors as A
from attestlake.functions import text as X
from attestlake.operators.lineage import spread
from attestlake.operators.relational import exploded

#: Words of the key that a claim and its sources share, characters of the key of a needle without inner words, and the
#: largest set of texts that is broadcast.
WINDOW, GRAM, MOST_NEEDLES, MOST_BYTES = 4, 4, 200_000, 50_000_000


def normal(text: str | Column) -> Column:
    """Space runs become one space, typographic quotes and dashes plain ones; case stays."""
    raw = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    folded = F.when(raw.rlike("[‘’“”‐‑‒–—]"), F.translate(raw, "‘’“”‐‑‒–—", "''\"\"-----")).otherwise(raw)
    return F.trim(F.regexp_replace(folded, r"[ \t\n\r]+", " "))


def claims_of(drafts: DataFrame, id_: str, text: str) -> DataFrame:
    """Sentences of drafts: id_, ord, claim. A full stop, ! or ? before a space ends one."""
    cut = F.split(F.regexp_replace(normal(text), r"([.!?]) ", "$1\n"), "\n")
    return drafts.select(id_, F.posexplode(cut).alias("ord", "claim")).where("claim <> ''")


def _held(own: DataFrame, src: DataFrame, whole_words: bool) -> DataFrame:
    """src's columns but body, with each needle of own (needle, n, head: n of its words) that body holds, once a row of src.

    Needles are few as a rule: a counted set of at most MOST_NEEDLES, with at most MOST_BYTES, is broadcast by head, the windows of a text are
    looked up where it is read, and only hits leave the task. A larger set meets the hashed windows in a join; the text
    is met again by candidates only.
    """
    keep = [c for c in src.columns if c != "body"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "body")
    lengths = sorted(r.n for r in own.select("n").distinct().collect())  # at most WINDOW values
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("needle") + F.octet_length("head")), F.lit(0)).alias("bytes")).first()
    if size.n <= MOST_NEEDLES and size.bytes <= MOST_BYTES:
        heads: dict[str, list[str]] = {}
        for r in own.collect():
            heads.setdefault(r.head, []).append(r.needle)
        known = src.sparkSession.sparkContext.broadcast(heads)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edge = " " if whole_words else ""
            for batch in batches:
                rows, found = [], []
                for i, body in enumerate(batch.column(len(keep)).to_pylist()):
                    w = body.split(" ")
                    met = {" ".join(w[k : k + n]) for n in lengths for k in range(len(w) - n + 1)} & known.value.keys()
                    own = sorted(x for h in met for x in known.value[h] if f"{edge}{x}{edge}" in f"{edge}{body}{edge}")
                    rows += [i] * len(own)
                    found += own
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(keep)]), pa.array(found, pa.string())], [*keep, "needle"])

        return spread(src.select(*keep, "body")).mapInArrow(run, f"{kinds}{', ' if kinds else ''}needle string")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = text.split(" ")
                heads = list({" ".join(w[i : i + n]) for n in lengths for i in range(len(w) - n + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(heads), pa.int64()), pa.array(heads, pa.string())], ["of", "head"])

    src = src.withColumn("of", F.xxhash64("body"))
    at = src.select("of", "body").mapInArrow(windows, "of long, head string").select("of", F.xxhash64("head").alias("key"))
    pairs = at.join(own.select("needle", F.xxhash64("head").alias("key")), "key").select("of", "needle").distinct()
    edge = F.lit(" " if whole_words else "")
    return src.join(pairs, "of").where(F.concat(edge, "body", edge).contains(F.concat(edge, "needle", edge))).select(*keep, "needle")


def gram_rows(bodies: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """keep, key: the distinct substrings of these lengths inside the words of each body (column body); length 0 gives one empty key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                words = set(text.split(" "))
                keys = list({w[k : k + n] for w in words for n in lengths for k in range(len(w) - n + 1)})
                at = pa.array([i] * len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(keep)]), pa.array(keys, pa.string())], [*keep, "key"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in bodies.select(*keep).schema.fields)
    return bodies.select(*keep, F.coalesce("body", F.lit("")).alias("body")).mapInArrow(run, f"{kinds}key string")


def _held_short(own: DataFrame, src: DataFrame) -> DataFrame:
    """As _held, for needles that have no word between their first and last: their first word lies inside a word of each
    body that holds them, so the GRAM characters it begins with are the key, and the text is met again by candidates only."""
    first = F.filter(F.split("needle", " "), lambda w: w != "")
    own = own.select("needle", F.coalesce(F.substring(F.try_element_at(first, F.lit(1)), 1, GRAM), F.lit("")).alias("key"))
    keep = [c for c in src.columns if c != "body"]
    lengths = sorted(r.n for r in own.select(F.length("key").alias("n")).distinct().collect())  # at most GRAM + 1 values
    if not lengths:
        return src.where("false").select(*keep, F.lit("").alias("needle"))
    src = src.withColumn("of", F.xxhash64("body"))
    pairs = gram_rows(src.select("of", "body").distinct(), lengths, "of").join(own, "key").select("of", "needle").distinct()
    return src.join(pairs, "of").where(F.contains("body", "needle")).select(*keep, "needle")


def found_verbatim(claims: DataFrame, sources: DataFrame, claim: str, text: str, source_id: str) -> DataFrame:
    """Claim texts and the number of sources that hold them whole, at word boundaries; equal claims are looked up once."""
    w = F.split("needle", " ")
    own = claims.select(F.col(claim).alias("needle")).where("needle IS NOT NULL").distinct().withColumn("n", F.least(F.size(w), F.lit(WINDOW)))
    own = own.withColumn("head", F.array_join(F.slice(w, F.lit(1), F.col("n")), " "))
    held = _held(own, sources.select(F.col(source_id).alias("sid"), normal(text).alias("body")), True)
    return held.groupBy(F.col("needle").alias("claim")).agg(F.countDistinct("sid").alias("n_sources"))


def containment(needles: DataFrame, sources: DataFrame, needle: str, body: str) -> DataFrame:
    """Rows of sources without body, with each distinct needle that body contains, also when it starts or ends inside a word.

    Both texts come normalized, with one space between words. The first and last word of a needle may be parts of
    words, so it is looked up by the WINDOW words after its first (those before its last, if fewer); needles of one or
    two words by the characters that their first word begins with. The empty needle is in every source.
    """
    keep = [c for c in sources.columns if c != body]
    words = F.split("needle", " ")
    own = needles.select(F.col(needle).alias("needle")).where("needle IS NOT NULL").distinct().withColumn("n", F.least(F.size(words) - 2, F.lit(WINDOW)))
    src = sources.select(*keep, F.coalesce(F.col(body), F.lit("")).alias("body"))
    held = _held(own.where("n > 0").withColumn("head", F.array_join(F.slice(words, F.lit(2), F.col("n")), " ")), src, False)
    return held.unionByName(_held_short(own.where("n <= 0"), src)).withColumnRenamed("needle", needle)


def fold_states(claims: DataFrame, id_: str, state: str) -> DataFrame:
    """altered before could_not_check before verified; per draft, with counts."""
    rank = F.max(F.when(F.col(state) == "altered", 2).when(F.col(state) == "could_not_check", 1).otherwise(0))
    return claims.groupBy(id_).agg(
        F.count("*").alias("n_claims"), F.count_if(F.col(state) == "verified").alias("n_verified"),
        F.when(rank == 2, "altered").when(rank == 1, "could_not_check").otherwise("verified").alias("state"),
    )


def attest_verbatim(drafts: DataFrame, sources: DataFrame, id_: str, text: str, source_text: str, source_id: str) -> DataFrame:
    """Per draft: its sentences found word for word in whole sources, and the fold of their states. No sentences: could_not_check."""
    claims = claims_of(drafts, id_, text)
    held = found_verbatim(claims, sources, "claim", source_text, source_id)
    states = claims.join(held, "claim", "left").withColumn("state", F.when(F.coalesce("n_sources", F.lit(0)) > 0, "verified").otherwise("altered"))
    out = drafts.select(id_).distinct().join(fold_states(states, id_, "state"), id_, "left")
    zero = F.lit(0).cast("long")
    return out.select(id_, F.coalesce("n_claims", zero).alias("n_claims"), F.coalesce("n_verified", zero).alias("n_verified"), F.coalesce("state", F.lit("could_not_check")).alias("state"))


def sentences(docs: DataFrame, id_: str, text: str, *keep: str) -> DataFrame:
    """id, start, sentence of each sentence of each text."""
    return exploded(docs, X.sentence_spans(text), "s", id_, *keep).select(id_, *keep, "s.start", "s.sentence")


def anchor_rows(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, type, text, start, end, canonical, subject of every typed value in each sentence of each text, with the uses of
    the terms that the text itself defines. Map-only and native; sentences without a hint of a value are left at once."""
    found = exploded(sentences(spread(docs).where(F.col(text).rlike(A.HINT)), id_, text).where(F.col("sentence").rlike(A.HINT)), A.anchors("sentence"), "a", id_, "start")
    out = found.select(id_, "a.type", "a.text", (F.col("start") + F.col("a.start")).alias("start"), (F.col("start") + F.col("a.end")).alias("end"), "a.canonical", "a.subject")
    defining = docs.where(F.col(text).rlike(A.DEFINED)).select(id_, F.col(text).alias("body"), F.explode(A.defined_terms(text)).alias("term"))
    return out.unionByName(defining.select(id_, F.inline(A.uses_of(F.col("body"), F.col("term")))))
