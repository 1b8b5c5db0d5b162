"""Retrieval: lexical and vector arms, fusion, reranking, grounding ranks and fallbacks.

Queries are the benchmark items, or every vector whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestlake.functions import text as X
from attestlake.operators import relational as R
from attestlake.operators import retrieval as V
from attestlake.operators import vectors
from attestlake.plans.base import Book, t

q = Book()
QUERIES, ORACLE = q.queries, q.oracle


def asked(s, d):
    return t(s, d, "benchmark").select("item_id", X.matches(F.lower("text"), "[a-z]{3,}").alias("words"))


def _bm25(text, k, where="TRUE"):
    return f"""
terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM benchmark),
tok AS (SELECT doc_id, regexp_extract_all(lower({text}), '[a-z]{{3,}}') AS t FROM documents WHERE {where}),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM tok),
tf AS (SELECT doc_id, len, w, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS w FROM tok) WHERE w IN (SELECT w FROM terms) GROUP BY ALL),
df AS (SELECT w, greatest(1e-6, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM tf, st GROUP BY w),
sc AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (w) JOIN terms USING (w), st GROUP BY 1, 2),
lex AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {k})
"""


@q(f"WITH {_bm25('coalesce(text, chr(32))', 10)} SELECT * FROM lex")
def R1_bm25_chunks(s, d):
    return V.bm25(t(s, d, "documents"), "doc_id", ["text"], asked(s, d), "item_id", 10)


_TWO = "coalesce(text, '') || ' ' || source || ' ' || lang"


@q(f"WITH {_bm25(_TWO, 10, where=chr(39) + 'en' + chr(39) + ' = lang')} SELECT * FROM lex")
def R2_bm25_nodes_in_scope(s, d):
    nodes = R.scope_filter(t(s, d, "documents"), {"lang": "en"}, {"source": None})
    return V.bm25(nodes, "doc_id", ["text", "source", "lang"], asked(s, d), "item_id", 10)


def _knn(k):
    return f"""
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
near AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.e, b.e) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= {k})
"""


def _near(s, d, k):
    e = t(s, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", k)


@q(f"WITH {_knn(10)} SELECT query_id, vec_id, round(-distance, 9) AS score, rank FROM near")
def R3_vector_knn(s, d):
    return _near(s, d, 10).select("query_id", "vec_id", F.round(-F.col("distance"), 9).alias("score"), "rank")


@q(f"""
WITH {_knn(40)} SELECT query_id, near.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM near JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = near.vec_id WHERE a.label = b.label QUALIFY place <= 10
""")
def T2_filtered_knn(s, d):
    # four times as many candidates as asked for, then the filter
    label = t(s, d, "embeddings").select("vec_id", "label")
    j = _near(s, d, 40).join(label, "vec_id").join(label.toDF("query_id", "own"), "query_id").where("label = own")
    return R.topk_per_key(j, ["query_id"], [F.col("rank")], 10, "place").select("query_id", "vec_id", F.col("place").cast("long").alias("place"))


@q(r"SELECT a.vec_id, b.vec_id AS other, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def N13_distances(s, d):
    e = t(s, d, "embeddings").select("vec_id", "embedding")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b")), "vec_id")
    cosine = 1 - X.dot("embedding", "b") / F.sqrt(X.dot("embedding", "embedding") * X.dot("b", "b"))
    return j.select("vec_id", "other", F.round(cosine, 9).alias("cosine"), F.round(X.l2_distance("embedding", "b"), 9).alias("l2"))


#: Words that ask for nodes of a type, beside those always asked for.
KEYWORDS, BASE = (("that", "table"), ("and", "caption"), ("ing", "formula"), ("tion", "figure"), ("est", "table"), ("the", "definition")), ("body", "list_item")
_KEYS = ", ".join(f"('{k}', '{v}')" for k, v in KEYWORDS)


@q(f"""
WITH terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM benchmark), k(w, type) AS (VALUES {_KEYS}),
x AS (SELECT item_id, type FROM terms JOIN k USING (w) UNION SELECT item_id, unnest(['body', 'list_item']) FROM benchmark)
SELECT item_id, list_sort(list(DISTINCT type)) AS types FROM x GROUP BY 1
""")
def F10_node_type_routing(s, d):
    return V.routed_types(asked(s, d), "item_id", "words", s.createDataFrame(list(KEYWORDS), "keyword string, type string"), BASE)


_TYPES = "(['body', 'list_item', 'table', 'caption', 'formula', 'figure', 'definition'])[doc_id % 7 + 1]"
_ARMS = f"""{_bm25(_TWO, 50)}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vec AS (SELECT a.vec_id AS item_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= 50),
fused AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(arm) AS first_arm FROM (SELECT item_id, doc_id, rank, 0 AS arm FROM lex UNION ALL SELECT item_id, doc_id, rank, 1 FROM vec) GROUP BY 1, 2)"""


def fused(s, d):
    """item_id, doc_id, rrf, first_arm of two arms of 50; ties are broken by the arm that found a row first."""
    lex = V.bm25(t(s, d, "documents"), "doc_id", ["text", "source", "lang"], asked(s, d), "item_id", 50)
    e, items = t(s, d, "embeddings"), t(s, d, "benchmark").select(F.col("item_id").alias("vec_id")).distinct()
    vec = vectors.nearest(e, e.join(items, "vec_id", "left_semi"), "vec_id", "embedding", 50).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank")
    out = R.rank_fusion([lex.select("item_id", "doc_id", "rank"), vec], ["item_id"], "doc_id")
    return out.select("item_id", "doc_id", F.round("score", 9).alias("rrf"), F.col("first.arm").alias("first_arm"))


@q(f"""WITH {_ARMS} SELECT item_id, doc_id, rrf, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, first_arm, doc_id) AS rank FROM fused QUALIFY rank <= 10""")
def R4_hybrid_two_arms(s, d):
    return R.topk_per_key(fused(s, d), ["item_id"], [F.desc("rrf"), F.col("first_arm"), F.col("doc_id")], 10).select("item_id", "doc_id", "rrf", F.col("rank").cast("long").alias("rank"))


@q(f"""
WITH {_ARMS}, k(w, type) AS (VALUES {_KEYS}), r AS (SELECT item_id, type FROM terms JOIN k USING (w) UNION SELECT item_id, unnest(['body', 'list_item']) FROM benchmark)
SELECT item_id, doc_id, {_TYPES} AS type, rrf, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, first_arm, doc_id) AS rank FROM fused WHERE (item_id, {_TYPES}) IN (SELECT (item_id, type) FROM r) QUALIFY rank <= 10
""")
def R5_typed_hybrid(s, d):
    kinds = F.array(*map(F.lit, ("body", "list_item", "table", "caption", "formula", "figure", "definition")))
    x = fused(s, d).withColumn("type", F.get(kinds, (F.col("doc_id") % 7).cast("int"))).join(F10_node_type_routing(s, d), "item_id").where(F.array_contains("types", F.col("type")))
    return R.topk_per_key(x, ["item_id"], [F.desc("rrf"), F.col("first_arm"), F.col("doc_id")], 10).select("item_id", "doc_id", "type", "rrf", F.col("rank").cast("long").alias("rank"))


_LIST = "list_distinct(regexp_extract_all(lower(coalesce({}.text, '')), '[a-z]{{3,}}'))"


@q(f"""
WITH {_ARMS}, top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, first_arm, doc_id) AS r FROM fused QUALIFY r <= 20),
j AS (SELECT top.*, len(list_intersect({_LIST.format('b')}, {_LIST.format('c')}))::DOUBLE / greatest(1, len(list_distinct(list_concat({_LIST.format('b')}, {_LIST.format('c')})))) AS model
  FROM top JOIN benchmark b USING (item_id) JOIN documents c USING (doc_id)),
m AS (SELECT *, CASE WHEN max(model) OVER w = min(model) OVER w THEN 1.0 ELSE (model - min(model) OVER w) / (max(model) OVER w - min(model) OVER w) END AS a,
  CASE WHEN max(rrf) OVER w = min(rrf) OVER w THEN 1.0 ELSE (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w) END AS b FROM j WINDOW w AS (PARTITION BY item_id))
SELECT item_id, doc_id, round(0.7 * a + 0.3 * b, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(0.7 * a + 0.3 * b, 6) DESC, doc_id) AS rank FROM m
""")
def R6_rerank_blend(s, d):
    # the model's place is taken by the overlap of words; any function of the pair may stand there
    top = R.topk_per_key(fused(s, d), ["item_id"], [F.desc("rrf"), F.col("first_arm"), F.col("doc_id")], 20)
    words = lambda c: F.array_distinct(X.matches(F.lower(c), "[a-z]{3,}"))
    j = top.drop("rank").join(t(s, d, "benchmark").select("item_id", words("text").alias("b")), "item_id").join(t(s, d, "documents").select("doc_id", words("text").alias("c")), "doc_id")
    j = j.withColumn("model", X.jaccard("b", "c"))
    score = F.round(0.7 * R.min_max("model", ["item_id"]) + 0.3 * R.min_max("rrf", ["item_id"]), 6)
    j = j.select("item_id", "doc_id", score.alias("score"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")).cast("long"))


@q(f"""
WITH terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM benchmark),
tok AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}')) AS w FROM documents) GROUP BY ALL),
o AS (SELECT item_id, doc_id, sum(n)::BIGINT AS overlap FROM terms JOIN tok USING (w) GROUP BY 1, 2),
sc AS (SELECT item_id, doc_id, overlap, overlap * 5 + 3 * (SELECT count(*) FROM terms t WHERE t.item_id = o.item_id AND contains(source, w)) + 2 * (SELECT count(*) FROM terms t WHERE t.item_id = o.item_id AND w = lang) + CASE WHEN n_chars > 1000 THEN 0.5 ELSE 0 END AS score
  FROM o JOIN documents USING (doc_id))
SELECT item_id, doc_id, overlap, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10
""")
def R7_grounding_rank(s, d):
    # documents without a shared word never meet a query, which is the rule unless no document shares one
    terms = asked(s, d).select("item_id", F.array_distinct("words").alias("words"))
    of = terms.select("item_id", F.explode("words").alias("w"))
    # words that no item asks for go before anything is shuffled
    tok = t(s, d, "documents").select("doc_id", F.explode(X.matches(F.lower("text"), "[a-z]{3,}")).alias("w")).join(of.select("w").distinct(), "w", "left_semi").groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    o = tok.join(of, "w").groupBy("item_id", "doc_id").agg(F.sum("n").alias("overlap"))
    j = o.join(t(s, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id").join(terms, "item_id")
    hits = lambda f: F.size(F.filter("words", f))
    score = F.col("overlap") * 5 + 3 * hits(lambda w: F.contains("source", w)) + 2 * hits(lambda w: w == F.col("lang")) + F.when(F.col("n_chars") > 1000, 0.5).otherwise(0.0)
    j = j.select("item_id", "doc_id", "overlap", score.cast("double").alias("score"))
    return R.topk_per_key(j, ["item_id"], [F.desc("score"), F.col("doc_id")], 10).withColumn("rank", F.col("rank").cast("long"))


@q(f"""
WITH terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM benchmark),
tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}')) AS w FROM documents), o AS (SELECT item_id, doc_id, count(*) AS overlap FROM terms JOIN tok USING (w) GROUP BY 1, 2),
n AS (SELECT item_id, min(w) AS name, max(w) AS summary FROM terms GROUP BY 1),
sc AS (SELECT item_id, doc_id, overlap * 4 + CASE WHEN contains(lower(text), name) THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), summary) THEN 3 ELSE 0 END AS score FROM o JOIN n USING (item_id) JOIN documents USING (doc_id))
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 4
""")
def R8_supporting_chunks(s, d):
    terms = asked(s, d).select("item_id", F.explode(F.array_distinct("words")).alias("w"))
    tok = t(s, d, "documents").select("doc_id", F.explode(F.array_distinct(X.matches(F.lower("text"), "[a-z]{3,}"))).alias("w"))
    o = terms.join(tok.join(terms.select("w").distinct(), "w", "left_semi"), "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap"))
    j = o.join(terms.groupBy("item_id").agg(F.min("w").alias("name"), F.max("w").alias("summary")), "item_id").join(t(s, d, "documents").select("doc_id", F.lower("text").alias("text")), "doc_id")
    score = F.col("overlap") * 4 + F.when(F.contains("text", "name"), 3).otherwise(0) + F.when(F.contains("text", "summary"), 3).otherwise(0)
    return R.topk_per_key(j.select("item_id", "doc_id", score.cast("long").alias("score")), ["item_id"], [F.desc("score"), F.col("doc_id")], 4).withColumn("rank", F.col("rank").cast("long"))


@q("""
WITH x AS (SELECT doc_id, 0 AS level, l.doc_id AS hit FROM documents JOIN labels l USING (doc_id) WHERE quality = 1 UNION ALL
  SELECT d.doc_id, 1, b.item_id FROM documents d JOIN benchmark b ON b.item_id = d.doc_id UNION ALL SELECT d.doc_id, 2, m.last FROM documents d JOIN (SELECT source, max(doc_id) AS last FROM documents GROUP BY 1) m USING (source))
SELECT doc_id, level, hit FROM x QUALIFY level = min(level) OVER (PARTITION BY doc_id)
""")
def R11_scope_fallback(s, d):
    docs = t(s, d, "documents").select("doc_id", "source")
    own = docs.join(t(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("doc_id").alias("hit"))
    items = docs.join(t(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("hit")), "doc_id").select("doc_id", "hit")
    newest = docs.join(docs.groupBy("source").agg(F.max("doc_id").alias("hit")), "source").select("doc_id", "hit")
    return V.first_level([own, items, newest], "doc_id").select("doc_id", "level", "hit")


@q(f"WITH {_knn(5)} SELECT query_id, vec_id, rank, coalesce(source, 'Source') AS name FROM near LEFT JOIN (SELECT * FROM documents WHERE lang <> 'de') ON doc_id = vec_id")
def R12_hydrated_hits(s, d):
    # hits keep the name "Source" where their document is gone
    names = t(s, d, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("vec_id"), "source")
    return _near(s, d, 5).join(names, "vec_id", "left").select("query_id", "vec_id", "rank", F.coalesce("source", F.lit("Source")).alias("name"))


@q("SELECT source, count(*) AS missing, CAST(ceil(count(*) / 64.0) AS BIGINT) AS batches FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1")
def R10_backfill_batches(s, d):
    gap = t(s, d, "documents").select("doc_id", "source").join(t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return gap.groupBy("source").agg(F.count("*").alias("missing"), F.ceil(F.count("*") / 64).alias("batches"))
