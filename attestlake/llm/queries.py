"""Queries opN_<name> over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestlake.llm import bagminhash, balltree, bpe, chat, decontam, html, linededup, phrases, quality, rpforest, runs, secrets, urls
from attestlake.llm.common import table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.withColumn("spans", spans)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rpforest.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, ids=False)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.scan(docs, secrets.train(spark), path=F.col("source"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return balltree.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.planted(table(spark, sf_dir, "documents")), keep_text=False))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_perspective_rotation, op2_decontamination, op3_bagminhash, op4_rp_forest, op5_byte_bpe, op6_line_dedup, op7_html_text, op8_secret_scan,
        op9_url_filter, op10_quality, op11_ball_tree, op12_periodic_runs, op13_collocations,
    )
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_perspective_rotation": """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, who AS speaker FROM t WHERE who <> 'system'),
r AS (
  SELECT t.*, speaker, who = speaker AS own,
    CASE WHEN who = 'system' THEN '<|system|>' WHEN who = speaker THEN '<|assistant|>' ELSE '<|user name=' || who || '|>' END || chr(10) AS head,
    chr(10) || '<|end|>' || chr(10) AS tail
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c
), s AS (
  SELECT *, coalesce(sum(length(head) + length(text) + length(tail)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a,
    row_number() OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, text) AS n
  FROM r
)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own, string_agg(head || text || tail, '' ORDER BY n) AS text,
  coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a AS BIGINT) + length(text) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE own), '') AS spans
FROM s GROUP BY conv_id, speaker
""",
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p + 1:p + n], ' ') AS gram
  FROM (SELECT *, unnest(range(len(w) - n + 1)) AS p FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))
), l AS (SELECT DISTINCT n FROM g),
x AS (
  SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, l WHERE len(w) >= n)
), h AS (SELECT doc_id, x.n, p, item_id FROM x JOIN g ON x.n = g.n AND x.gram = g.gram),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_line_dedup": f"""
WITH x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS key FROM x),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT *, key IN (SELECT key FROM bad) AS gone FROM k) GROUP BY doc_id
""",
    "op9_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}) AS r(h, p, v)),
m AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)
""",
    "op11_ball_tree": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 5
""",
    "op12_periodic_runs": r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(1, 9)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tbl FROM (SELECT unnest(range(0, 256)) AS i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (
  SELECT rid, doc_id, w, len(w) AS n,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(tbl[xor(c, b) % 256 + 1], c // 256))) AS h
  FROM d, tab
), a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN h // 10 % n END AS a FROM c),
x AS (
  SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + h // 10 % 8)) + 1])) END AS w FROM a
), per AS (
  SELECT rid, n, w, unnest(list_filter(range(1, n // 4 + 1), lambda p: len(list_filter(range(0, (n - 1) // p - 2),
    lambda j: w[j * p + 1] = w[(j + 1) * p + 1] AND w[(j + 1) * p + 1] = w[(j + 2) * p + 1] AND w[(j + 2) * p + 1] = w[(j + 3) * p + 1])) > 0)) AS p FROM x
), same AS (SELECT rid, p, unnest(list_filter(range(0, n - p), lambda i: w[i + 1] = w[i + p + 1])) AS i FROM per),
isl AS (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS g FROM same),
cand AS (SELECT rid, p, min(i) AS s, count(*) + p AS len FROM isl GROUP BY rid, p, g HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT rid, s, len, min(p) AS p FROM cand GROUP BY ALL),
g AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS runs, first({'s': s, 'l': len, 'p': p} ORDER BY len DESC, s, p) AS top FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + p, s + len)) AS i FROM r),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM (SELECT rid, unnest(w) AS w, unnest(range(0, n)) AS i FROM x) ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM x LEFT JOIN g USING (rid) LEFT JOIN kept USING (rid)
""",
    "op13_collocations": rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM t),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(ws[i + 1:i + k], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM w, range(1, 6) r(k) WHERE len(ws) >= k) GROUP BY ALL HAVING count(*) >= 100
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM g WHERE k > 1),
s AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, (1000 * c.a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score, cut
  FROM c JOIN totals USING (lang) JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
    JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:c.k], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = s.lang AND g.k > 2 AND g.f >= s.a AND length(g.phrase) > length(s.phrase) AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))
QUALIFY rank <= 2000
""",
}
