"""Filters, joins, aggregates, windows, top-k and set operations over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestlake.operators import relational as R
from attestlake.plans.base import Book, t

q = Book()
QUERIES, ORACLE = q.queries, q.oracle
TODAY = "1997-01-01"


@q("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1')")
def F1_scope_filter(s, d):
    return R.scope_filter(t(s, d, "documents").select("doc_id", "lang", "source"), {"lang": "en"}, {"source": ["src0", "src1"], "doc_id": None})


@q("SELECT doc_id FROM documents WHERE false")
def F1_scope_filter_empty_list(s, d):
    return R.scope_filter(t(s, d, "documents").select("doc_id"), {}, {"doc_id": []})


@q("SELECT coalesce(nullif(trim(CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE source END), ''), 'General') AS subject, count(*) AS n FROM documents GROUP BY 1")
def F2_default_dimension(s, d):
    named = t(s, d, "documents").select(R.or_default(F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("source"))).alias("subject"))
    return named.groupBy("subject").agg(F.count("*").alias("n"))


@q(f"SELECT o_orderkey FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS due FROM orders) WHERE due IS NULL OR due <= TIMESTAMP '{TODAY}'")
def F3_due_predicate(s, d):
    o = t(s, d, "orders").withColumn("due", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))
    return o.where(R.is_due(F.col("due"), F.lit(TODAY).cast("timestamp"))).select("o_orderkey")


@q("""
SELECT p_partkey, CASE WHEN p_size < 15 THEN 'weak' WHEN p_size < 35 THEN 'fair' ELSE 'strong' END AS band,
  CASE WHEN p_retailprice / 2000 >= 0.7 THEN 'hard' WHEN p_retailprice / 2000 >= 0.45 THEN 'medium' ELSE 'easy' END AS difficulty FROM part
""")
def F5_bucket_bands(s, d):
    p, r = t(s, d, "part"), F.col("p_retailprice") / 2000
    return p.select(
        "p_partkey", F.when(F.col("p_size") < 15, "weak").when(F.col("p_size") < 35, "fair").otherwise("strong").alias("band"),
        F.when(r >= 0.7, "hard").when(r >= 0.45, "medium").otherwise("easy").alias("difficulty"),
    )


@q("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('R', 'N')")
def F9_type_denylist(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").where(~F.col("l_returnflag").isin("R", "N"))


@q("""
SELECT n_name, c_mktsegment, count(*) AS orders, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2
""")
def J1_inner_chain(s, d):
    o = t(s, d, "orders").select("o_custkey", "o_totalprice")
    c = t(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t(s, d, "nation").select("n_nationkey", "n_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def J2_left_chain(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_nationkey")
    j = c.join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", "n_name", "r_name")


@q("""
SELECT user_id, event_id, c_name FROM (SELECT *, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END, event_id % 50) AS k FROM events)
LEFT JOIN customer ON k = c_custkey
""")
def J3_computed_key(s, d):
    e = t(s, d, "events").select("user_id", "event_id")
    e = e.withColumn("k", F.coalesce(F.when(F.col("event_id") % 3 != 0, F.col("user_id")), F.col("event_id") % 50))
    return e.join(t(s, d, "customer").select("c_custkey", "c_name"), F.col("k") == F.col("c_custkey"), "left").select("user_id", "event_id", "c_name")


@q("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def J4_latest_row(s, d):
    return R.latest_row(t(s, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@q("""
SELECT c_custkey, event_id AS last_event FROM customer LEFT JOIN
(SELECT user_id, max_by(event_id, event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1) ON c_custkey = user_id
""")
def J5_latest_lookup(s, d):
    e = t(s, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("event_id").alias("last_event"))
    return t(s, d, "customer").select("c_custkey").join(e, "c_custkey", "left")


EDGES = "(SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem)"


def _edges(s, d):
    return t(s, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()


@q(f"""
SELECT DISTINCT node, neighbour FROM (SELECT source AS node, target AS neighbour FROM {EDGES} UNION SELECT target, source FROM {EDGES})
WHERE node IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
""")
def J6_neighbours_either_way(s, d):
    return R.incident_edges(_edges(s, d), t(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("node")))


@q(f"SELECT source, target FROM {EDGES} WHERE source IN (SELECT p_partkey FROM part WHERE p_size <= 10) AND target IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def J7_induced_edges(s, d):
    return R.induced_edges(_edges(s, d), t(s, d, "part").where("p_size <= 10").select("p_partkey"), "p_partkey")


@q("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def J8_rows_without_match(s, d):
    return t(s, d, "documents").select("doc_id").join(t(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@q("SELECT vec_id FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)")
def J9_orphans(s, d):
    return t(s, d, "embeddings").select("vec_id").join(t(s, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@q("SELECT doc_id, source FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)")
def J10_exists(s, d):
    return t(s, d, "documents").select("doc_id", "source").join(t(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@q("""
SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
WHERE o_orderpriority = '1-URGENT'
""")
def J11_bridge(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    j = li.join(o, "l_orderkey").join(t(s, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.join(t(s, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@q("""
WITH a AS (SELECT l_partkey AS id, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_partkey) AS r FROM lineitem GROUP BY 1 QUALIFY r <= 30),
b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 30)
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, count(*) AS n_arms FROM (FROM a UNION ALL FROM b) GROUP BY id
""")
def J12_rank_fusion(s, d):
    a = t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("v")).orderBy(F.desc("v"), "id").limit(30)
    b = t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v")).orderBy(F.desc("v"), "id").limit(30)
    w = Window.orderBy(F.desc("v"), "id")  # at most 30 rows
    out = R.rank_fusion([x.withColumn("rank", F.row_number().over(w)) for x in (a, b)], [], "id")
    return out.select("id", F.round("score", 9).alias("score"), F.size("arms").cast("long").alias("n_arms"))


@q("""
SELECT label, dimension, list_sort(list(DISTINCT v)) AS readings FROM (
  SELECT p_brand AS label, 'size' AS dimension, p_size AS v, p_partkey AS doc FROM part UNION ALL SELECT p_brand, 'kind', length(p_type), p_partkey FROM part)
GROUP BY 1, 2 HAVING count(DISTINCT v) > 1 AND count(DISTINCT doc) > 1
""")
def J17_facts_across_documents(s, d):
    p = t(s, d, "part")
    facts = p.select(F.col("p_brand").alias("label"), F.lit("size").alias("dimension"), F.col("p_size").alias("v"), F.col("p_partkey").alias("doc")).unionByName(
        p.select(F.col("p_brand").alias("label"), F.lit("kind").alias("dimension"), F.length("p_type").alias("v"), F.col("p_partkey").alias("doc"))
    )
    g = facts.groupBy("label", "dimension").agg(F.array_sort(F.collect_set("v")).alias("readings"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    return g.where("size(readings) > 1 AND lo <> hi").drop("lo", "hi")


@q("""
SELECT doc_id FROM (SELECT doc_id, md5(coalesce(text, '')) AS now, md5(coalesce(CASE WHEN doc_id % 10 = 0 THEN text || '.' ELSE text END, '')) AS snapshot FROM documents) WHERE now <> snapshot
""")
def J21_stale_snapshots(s, d):
    x = t(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    snap = x.select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("snapshot"))
    return x.select("doc_id", F.md5("text").alias("now")).join(snap, "doc_id").where("now <> snapshot").select("doc_id")


@q("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def A1_group_count(s, d):
    return t(s, d, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@q("SELECT source, count(*) AS docs, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS english, sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END)::BIGINT AS long_docs FROM documents GROUP BY 1")
def A2_conditional_sums(s, d):
    return t(s, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 2000).alias("long_docs"))


@q("SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def A3_having(s, d):
    return t(s, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1")


@q("SELECT event_type, max(ts) AS last_ts FROM events GROUP BY 1")
def A4_latest_per_group(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.max("ts").alias("last_ts"))


@q("SELECT DISTINCT p_type, p_brand FROM part")
def A5_distinct(s, d):
    return t(s, d, "part").select("p_type", "p_brand").distinct()


@q("""
SELECT source, count(*) AS docs, coalesce(sum(toxic), 0)::BIGINT AS toxic, count(quality) AS labelled, min_by(doc_id, doc_id) FILTER (WHERE quality = 0) AS first_bad, max(n_chars) AS longest
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
""")
def A6_subject_dashboard(s, d):
    j = t(s, d, "documents").select("doc_id", "source", "n_chars").join(t(s, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(
        F.count("*").alias("docs"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("quality").alias("labelled"),
        F.min(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("first_bad"), F.max("n_chars").alias("longest"),
    )


@q("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def A7_count_by_state(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


STATE = "CASE l_returnflag WHEN 'R' THEN 'altered' WHEN 'A' THEN 'verified' ELSE 'could_not_check' END"


@q(f"""
SELECT o_orderkey, CASE coalesce(max(r), 1) WHEN 2 THEN 'altered' WHEN 0 THEN 'verified' ELSE 'could_not_check' END AS state
FROM orders LEFT JOIN (SELECT l_orderkey, CASE {STATE} WHEN 'altered' THEN 2 WHEN 'verified' THEN 0 ELSE 1 END AS r FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1
""")
def A8_honesty_fold(s, d):
    li = t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr(STATE).alias("state"))
    folded = R.honesty_fold(li, ["o_orderkey"])
    return t(s, d, "orders").select("o_orderkey").join(folded, "o_orderkey", "left").select("o_orderkey", F.coalesce("state", F.lit(R.REFUSED)).alias("state"))


@q("""
WITH x AS (SELECT doc_id, md5(text) AS h, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 100 END AS day FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS canonical, count(*) OVER (PARTITION BY h) AS copies FROM x WINDOW w AS (PARTITION BY h ORDER BY day NULLS LAST, doc_id))
SELECT h, doc_id, canonical, copies, CASE WHEN doc_id = canonical THEN 'keep' ELSE 'remove' END AS role FROM r WHERE copies > 1
""")
def A9_duplicate_clusters(s, d):
    x = t(s, d, "documents").select("doc_id", F.md5("text").alias("h"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 100).alias("day"))
    return R.duplicate_clusters(x, "h", "day", "doc_id")


@q("""
SELECT p_brand, p_type, list_sort(list(DISTINCT p_size)) AS sizes, CASE WHEN count(DISTINCT hedge) > 1 OR max(hedge) = 'approx' THEN 'could_not_verify' ELSE 'contradicted' END AS verdict
FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'approx' ELSE 'exact' END AS hedge FROM part) GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1
""")
def A10_fact_ledger_groups(s, d):
    p = t(s, d, "part").withColumn("hedge", F.when(F.col("p_partkey") % 5 == 0, "approx").otherwise("exact"))
    g = p.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_size")).alias("sizes"), F.collect_set("hedge").alias("h"))
    return g.where("size(sizes) > 1").select("p_brand", "p_type", "sizes", F.when((F.size("h") > 1) | F.array_contains("h", "approx"), "could_not_verify").otherwise("contradicted").alias("verdict"))


@q("SELECT p_type FROM (SELECT p_type, CASE WHEN p_size % 2 = 0 THEN 'days' ELSE 'months' END AS family FROM part) GROUP BY 1 HAVING count(DISTINCT family) = 2")
def A11_two_unit_families(s, d):
    g = t(s, d, "part").groupBy("p_type").agg(F.collect_set(F.when(F.col("p_size") % 2 == 0, "days").otherwise("months")).alias("f"))
    return g.where(F.array_contains("f", "days") & F.array_contains("f", "months")).select("p_type")


@q("""
WITH li AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(20, 2)) AS v FROM lineitem),
x AS (SELECT l_orderkey, sum(v) AS total, count(*) AS items FROM li GROUP BY 1)
SELECT l_orderkey, CAST(total AS DOUBLE) AS total, CAST(total + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS stated,
  CASE WHEN items < 2 OR l_orderkey % 3 <> 0 THEN 'silent' ELSE 'contradicted' END AS verdict FROM x
""")
def A12_decimal_footing(s, d):
    g = t(s, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(20,2)").alias("v")).groupBy("l_orderkey").agg(F.sum("v").alias("total"), F.count("*").alias("items"))
    stated = F.col("total") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)
    verdict = F.when((F.col("items") < 2) | (stated == F.col("total")), "silent").otherwise("contradicted")
    return g.select("l_orderkey", F.col("total").cast("double").alias("total"), stated.cast("double").alias("stated"), verdict.alias("verdict"))


@q("SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) GROUP BY 1 HAVING count(*) >= 5")
def A13_token_frequency(s, d):
    return t(s, d, "documents").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]{4,}', 0)")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n >= 5")


@q("SELECT c_mktsegment, round(avg((c_acctbal + c_custkey) / 2), 3) AS level FROM customer GROUP BY 1")
def A14_mean_of_states(s, d):
    return t(s, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg((F.col("c_acctbal") + F.col("c_custkey")) / 2), 3).alias("level"))


@q("SELECT round(100.0 * sum(greatest(l_quantity - l_linenumber, 0)) / sum(greatest(l_quantity, 1)), 4) AS retention FROM lineitem")
def A15_retention(s, d):
    return t(s, d, "lineitem").agg(F.round(100.0 * F.sum(F.greatest(F.col("l_quantity") - F.col("l_linenumber"), F.lit(0))) / F.sum(F.greatest("l_quantity", F.lit(1))), 4).alias("retention"))


@q("""
WITH r AS (SELECT l_shipmode, v, row_number() OVER (PARTITION BY l_shipmode ORDER BY v) AS i, count(*) OVER (PARTITION BY l_shipmode) AS n FROM (SELECT l_linestatus AS l_shipmode, l_extendedprice AS v FROM lineitem))
SELECT l_shipmode AS grp, max(v) FILTER (WHERE i = least(n, CAST(floor(n * 0.5) AS BIGINT) + 1)) AS p50, max(v) FILTER (WHERE i = least(n, CAST(floor(n * 0.95) AS BIGINT) + 1)) AS p95, round(avg(v), 4) AS mean FROM r GROUP BY 1
""")
def A16_latency_percentiles(s, d):
    # the value of zero-based rank floor(n * p), found by a discrete percentile: an aggregate, so no hot sort
    x = t(s, d, "lineitem").select(F.col("l_linestatus").alias("grp"), F.col("l_extendedprice").alias("v"))
    n = x.groupBy("grp", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("grp").orderBy("v")
    r = n.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("grp")))
    at = lambda p: F.min(F.when(F.col("upto") >= F.least(F.col("n"), F.floor(F.col("n") * p) + 1), F.col("v")))
    return r.groupBy("grp").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 4).alias("mean"))


@q("""
SELECT truth, count(o) AS cases, count(*) FILTER (WHERE o IS NOT NULL AND got <> want) AS violations, count(o) > 0 AS exercised
FROM (VALUES ('altered', 'R'), ('faithful', 'A'), ('uncheckable', 'N'), ('unused', 'Z')) AS c(truth, flag)
LEFT JOIN (SELECT l_returnflag AS o, l_linestatus AS got, CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END AS want FROM lineitem) ON o = flag GROUP BY 1
""")
def A17_conformance_tally(s, d):
    classes = s.createDataFrame([("altered", "R"), ("faithful", "A"), ("uncheckable", "N"), ("unused", "Z")], "truth string, flag string")
    li = t(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("cases"), F.count_if(F.col("l_linestatus") != F.when(F.col("l_returnflag") == "N", "O").otherwise("F")).alias("violations"))
    j = F.broadcast(classes).join(li, "flag", "left").na.fill(0, ["cases", "violations"])
    return j.select("truth", "cases", "violations", (F.col("cases") > 0).alias("exercised"))


@q("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN hi - lo <= 0 THEN 1.0 ELSE (v - lo) / (hi - lo) END, 6) AS norm
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS v, min(l_quantity) OVER w AS lo, max(l_quantity) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
""")
def A18_min_max(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(R.min_max("l_quantity", ["l_orderkey"]), 6).alias("norm"))


@q("SELECT o_orderpriority AS surface, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS answered, round(count(*) FILTER (WHERE o_orderstatus = 'P')::DOUBLE / count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')), 6) AS false_rate FROM orders GROUP BY 1")
def A19_false_accept_rate(s, d):
    g = t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("surface")).agg(F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("answered"), F.count_if(F.col("o_orderstatus") == "P").alias("bad"))
    return g.select("surface", "answered", F.round(F.col("bad") / F.col("answered"), 6).alias("false_rate"))


@q("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value < 5) AS low, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 24 GROUP BY 1
""")
def A20_recent_counters(s, d):
    e = R.topk_per_key(t(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 24)
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") < 5).alias("low"), F.count("*").alias("n"))


@q("SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def W1_rank(s, d):
    return t(s, d, "part").select("p_type", "p_partkey", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))


@q("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations
""")
def W2_carry_forward(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t(s, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("last_user"))


@q("""
WITH r AS (SELECT user_id, event_id, value, sum(CASE WHEN event_type = 'login' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS region FROM events)
SELECT user_id, region::BIGINT AS region, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY 1, 2
""")
def W3_regions(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = t(s, d, "events").select("user_id", "value", F.sum(F.when(F.col("event_type") == "login", 1).otherwise(0)).over(w).alias("region"))
    return r.groupBy("user_id", "region").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@q("""
SELECT user_id, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> event_type) AS switches FROM (
  SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type <> 'view') GROUP BY 1
""")
def W5_topic_switches(s, d):
    e = t(s, d, "events").where("event_type <> 'view'")
    e = e.withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id").agg(F.count_if(F.col("prev").isNotNull() & (F.col("prev") != F.col("event_type"))).alias("switches"))


@q("""
WITH a AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS brk FROM conversations),
b AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT conv_id, island::BIGINT AS island, string_agg(text, ' ' ORDER BY turn) AS merged, sum(length(text) + 1)::BIGINT AS size FROM b GROUP BY 1, 2
""")
def W6_merge_islands(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t(s, d, "conversations").withColumn("brk", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1))
    x = x.withColumn("island", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("conv_id", "island").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"), F.sum(F.length("text") + 1).alias("size"))
    return g.select("conv_id", "island", F.array_join(F.transform("p", lambda p: p["text"]), " ").alias("merged"), "size")


@q("SELECT conv_id, turn, (sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text) - 2)::BIGINT AS start FROM conversations")
def W7_cumulative_offsets(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t(s, d, "conversations").select("conv_id", "turn", (F.sum(F.length("text") + 2).over(w) - F.length("text") - 2).alias("start"))


@q("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def W8_adjacent_duplicates(s, d):
    e = t(s, d, "events").withColumn("p", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where("p IS NULL OR p <> event_type").select("user_id", "event_id")


CLAMP = "list_reduce(list_prepend(0.5, list(CASE event_type WHEN 'purchase' THEN 0.1 WHEN 'click' THEN 0.03 ELSE -0.05 END ORDER BY ts, event_id)), lambda a, b: round(greatest(0, least(1, a + b)), 3))"


@q(f"SELECT user_id, round(CAST({CLAMP} AS DOUBLE), 3) AS mastery FROM events GROUP BY 1")
def W10_clamped_fold(s, d):
    # an ordered fold: clamping and rounding at every step, so no window sum
    g = t(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    delta = lambda e: F.when(e["event_type"] == "purchase", 0.1).when(e["event_type"] == "click", 0.03).otherwise(-0.05)
    fold = F.aggregate("e", F.lit(0.5), lambda a, e: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a + delta(e))), 3))
    return g.select("user_id", F.round(fold, 3).alias("mastery"))


@q("SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS occurrence FROM events")
def W11_nth_occurrence(s, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t(s, d, "events").select("user_id", "event_type", "event_id", F.row_number().over(w).alias("occurrence"))


@q("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders ORDER BY 2 NULLS LAST, 1")
def T3_nulls_last_all(s, d):
    # all orders, those without a date at the end; T3_nulls_last_sort stops after 50
    o = t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("o_orderdate"))
    return o.orderBy(F.asc_nulls_last("o_orderdate"), "o_orderkey")


@q("SELECT p_brand, arg_max(p_name, (p_retailprice, p_name)) AS best FROM part GROUP BY 1")
def T6_best_per_key(s, d):
    return t(s, d, "part").groupBy("p_brand").agg(F.max_by("p_name", F.struct("p_retailprice", "p_name")).alias("best"))


@q("SELECT s_suppkey, score FROM (SELECT s_suppkey, round((10000 - s_acctbal) / 100, 4) AS score, s_acctbal FROM supplier) ORDER BY score DESC, s_acctbal, s_suppkey LIMIT 1")
def T7_argmax_first_wins(s, d):
    x = t(s, d, "supplier").select("s_suppkey", F.round((10000 - F.col("s_acctbal")) / 100, 4).alias("score"), "s_acctbal")
    return x.orderBy(F.desc("score"), "s_acctbal", "s_suppkey").limit(1).select("s_suppkey", "score")


@q("SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size > 40) AS total FROM part WHERE p_size > 40 ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def T8_page_with_total(s, d):
    p = t(s, d, "part").where("p_size > 40").select("p_partkey", "p_name")
    return p.orderBy("p_name", "p_partkey").offset(40).limit(20).crossJoin(F.broadcast(p.agg(F.count("*").alias("total"))))


@q("SELECT l_orderkey, arg_min(l_returnflag, (CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber)) AS first_state FROM lineitem GROUP BY 1")
def T9_first_in_rank_order(s, d):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct(rank, F.col("l_linenumber"))).alias("first_state"))


@q(f"SELECT source AS a, target AS b FROM {EDGES} UNION SELECT target, source FROM {EDGES}")
def U1_union_distinct(s, d):
    e = _edges(s, d)
    return e.select(F.col("source").alias("a"), F.col("target").alias("b")).union(e.select("target", "source")).distinct()


@q("SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id FROM documents WHERE n_chars < 100 UNION ALL SELECT doc_id FROM documents WHERE lang = 'es')")
def U2_union_of_postings(s, d):
    x = t(s, d, "documents")
    return t(s, d, "labels").where("toxic = 1").select("doc_id").union(x.where("n_chars < 100").select("doc_id")).union(x.where("lang = 'es'").select("doc_id")).distinct()


NUMS = "list_distinct(regexp_extract_all({}, '[0-9]+'))"


@q(f"""
SELECT page_id, list_sort(list_filter({NUMS.format("html")}, lambda x: NOT list_contains({NUMS.format("url")}, x))) AS only_html,
  list_sort(list_filter({NUMS.format("url")}, lambda x: NOT list_contains({NUMS.format("html")}, x))) AS only_url FROM pages
""")
def U3_figure_differences(s, d):
    a, b = F.expr("regexp_extract_all(html, '[0-9]+', 0)"), F.expr("regexp_extract_all(url, '[0-9]+', 0)")
    return t(s, d, "pages").select("page_id", F.array_sort(F.array_except(a, b)).alias("only_html"), F.array_sort(F.array_except(b, a)).alias("only_url"))


@q("""
WITH x AS (SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b FROM conversations GROUP BY 1),
w AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(a), '[a-z]{3,}')) AS a, list_distinct(regexp_extract_all(lower(b), '[a-z]{3,}')) AS b FROM x WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT conv_id, list_sort(list_intersect(a, b))[1:4] AS shared, list_sort(list_filter(a, lambda x: NOT list_contains(b, x)))[1:4] AS only_a FROM w
""")
def U4_shared_and_own_tokens(s, d):
    g = t(s, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b"))
    w = lambda c: F.array_distinct(F.expr(f"regexp_extract_all(lower({c}), '[a-z]{{3,}}', 0)"))
    g = g.where("a IS NOT NULL AND b IS NOT NULL").select("conv_id", w("a").alias("a"), w("b").alias("b"))
    return g.select("conv_id", F.slice(F.array_sort(F.array_intersect("a", "b")), 1, 4).alias("shared"), F.slice(F.array_sort(F.array_except("a", "b")), 1, 4).alias("only_a"))


@q("""
WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard
FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0
""")
def U5_jaccard_pairs(s, d):
    # all pairs that share a token; U5_jaccard compares consecutive ids
    return jaccard_pairs(t(s, d, "benchmark"))


def jaccard_pairs(items):
    """A, b and the Jaccard index of their tokens, for each two items with a token in common."""
    w = items.select("item_id", F.array_distinct(F.expr("regexp_extract_all(lower(text), '[a-z]{3,}', 0)")).alias("w"))
    x = w.select("item_id", F.size("w").alias("n"), F.explode("w").alias("w"))
    a, b = (x.select(F.col("item_id").alias(c), F.col("n").alias("n" + c), "w") for c in "ab")
    both = a.join(b, "w").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    return both.select("a", "b", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"))


@q("SELECT item_id, list_distinct_ordered AS words FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark))")
def U6_ordered_distinct(s, d):
    return t(s, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("words"))
