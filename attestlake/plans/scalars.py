"""Number words, roman numerals, table cells, ambiguous dates, stems and artifacts, over values of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestlake.functions import anchors as A
from attestlake.functions import text as X
from attestlake.operators import attest, detect
from attestlake.plans.base import Book, t
from attestlake.plans.detectors import WORDS, say

q = Book()
QUERIES, ORACLE = q.queries, q.oracle


@q("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST((o_custkey % 50 + 1) * 1000 + o_orderkey % 9 * 100 + o_orderkey % 50 + 101 AS BIGINT) END AS value FROM orders")
def N7_N8_cardinals(s, d):
    word = lambda i: F.element_at(F.array(*map(F.lit, WORDS)), i.cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    spoken = say(word(c % 50 + 1), " thousand ", word(k % 9 + 1), " hundred ", F.when(k % 5 == 4, "and ").otherwise(""), word(k % 50 + 1))
    return t(s, d, "orders").select("o_orderkey", A.cardinal(spoken).alias("value"))


_ROMAN = "".join(f"(['', {', '.join(repr(x) for x in row)}])[p_partkey // {n} % 10 + 1] || " for n, row in ((100, ["c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]), (10, ["x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]), (1, ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"])))


@q(f"SELECT p_partkey, {_ROMAN} '' AS roman, CAST(p_partkey AS INT) AS back FROM part WHERE p_partkey BETWEEN 1 AND 999")
def N10_roman_numerals(s, d):
    p = t(s, d, "part").where("p_partkey BETWEEN 1 AND 999").select("p_partkey", X.to_roman(F.col("p_partkey")).alias("roman"))
    return p.withColumn("back", X.from_roman("roman"))


@q("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(n AS DOUBLE) WHEN 1 THEN CAST(-n AS DOUBLE) WHEN 2 THEN n * 1000000.0 END AS value FROM (SELECT *, c_custkey + 1000 AS n FROM customer)
""")
def N9_table_cells(s, d):
    k = F.col("c_custkey")
    n = F.format_number(k + 1000, 0)
    cell = F.when(k % 4 == 0, F.concat(F.lit("USD "), n)).when(k % 4 == 1, F.concat(F.lit("($"), n, F.lit(")"))).when(k % 4 == 2, F.concat(n, F.lit(" million"))).otherwise(F.concat(n, F.lit(",2")))
    return t(s, d, "customer").select("c_custkey", detect.cell_figure(cell).cast("double").alias("value"))


@q("""
SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS month_first, strftime(o_orderdate, '%Y-%m-%d') AS day_first,
  day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS ambiguous FROM orders
""")
def D2_ambiguous_dates(s, d):
    o = t(s, d, "orders").select("o_orderkey", X.date_readings(F.date_format("o_orderdate", "d/M/yyyy")).alias("r"))
    return o.select("o_orderkey", "r.month_first", "r.day_first", "r.ambiguous")


@q("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark)
SELECT word, CASE WHEN regexp_matches(word, 'ies$') AND length(word) > 5 THEN word[:-4] || 'y' WHEN regexp_matches(word, '(ing|est)$') AND length(word) > 6 THEN word[:-4] WHEN regexp_matches(word, 'ed$') AND length(word) > 5 THEN word[:-3]
  WHEN regexp_matches(word, '[^s]s$') THEN word[:-2] ELSE word END AS stem FROM w
""")
def X29_simple_stems(s, d):
    w = t(s, d, "benchmark").select(F.explode(X.matches(F.lower("text"), "[a-z]{4,}")).alias("word")).distinct()
    return w.select("word", X.simple_stem("word").alias("stem"))


@q(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace('Slide 3: ' || text || ' (cid:12) x', '^(Slide|Page) [0-9]+[:.] *', ''), '\(cid:[0-9]+\)', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS plain FROM documents""")
def X26_artifacts(s, d):
    raw = F.concat(F.lit("Slide 3: "), "text", F.lit(" (cid:12)­ x"))
    return t(s, d, "documents").select("doc_id", F.md5(X.strip_artifacts(raw)).alias("plain"))


@q("SELECT c_custkey, 'It said so. ' || c_name || ' paid 12 coins, ' || c_mktsegment || '. Then 3 more' AS plain FROM customer")
def X13_footnotes(s, d):
    raw = F.concat(F.lit("It said so.4 "), "c_name", F.lit(" paid 12 coins,17 "), "c_mktsegment", F.lit(".3 Then 3 more"))
    return t(s, d, "customer").select("c_custkey", X.strip_footnotes(raw).alias("plain"))


@q("""
SELECT c_custkey, 3 AS n, CAST(length('Dr. Who of ' || c_name || ' Inc. came to No. 5.') + 1 AS INT) AS second FROM customer
""")
def X8_sentences(s, d):
    text = F.concat(F.lit("Dr. Who of "), "c_name", F.lit(" Inc. came to No. 5. It rained\nand then stopped. "))
    x = attest.sentences(t(s, d, "customer").select("c_custkey", text.alias("s")), "c_custkey", "s")
    return x.groupBy("c_custkey").agg(F.count("*").cast("int").alias("n"), F.min(F.when(F.startswith("sentence", F.lit("It")), F.col("start"))).alias("second"))
