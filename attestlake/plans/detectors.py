"""Anchors and contradictions of texts that are built from the tables, so that SQL knows from the columns what has to come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestlake.functions import text as X
from attestlake.operators import attest, detect
from attestlake.operators.lineage import once_per_text
from attestlake.operators.retrieval import evaluation
from attestlake.plans.base import Book, t

q = Book()
QUERIES, ORACLE = q.queries, q.oracle

_ONES = list(X.ONES)
WORDS = [*_ONES, *(w if not k else f"{w} {_ONES[k - 1]}" for w in list(X.TENS)[:4] for k in range(10))][:50]
C, R = detect.CONTRADICTED, detect.REFUSED


def say(*parts):
    """The parts in a row: strings as they stand, columns as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_TEXT = "'Order K' || o_orderkey || ' totals $' || CAST(floor(o_totalprice) AS BIGINT) || ' and was placed on ' || strftime(o_orderdate, '%Y-%m-%d') || '. A fee of ' || (o_custkey % 90 + 1) || '% applies within ' || (o_orderkey % 60 + 1) || ' days under Section ' || (o_custkey % 9 + 1) || '.' || (o_orderkey % 9 + 1) || '.'"


@q(f"""
WITH x AS (SELECT *, {_TEXT} AS s FROM orders),
a AS (
  SELECT o_orderkey, s, 'money' AS type, '$' || CAST(floor(o_totalprice) AS BIGINT) AS text, CAST(CAST(floor(o_totalprice) AS BIGINT) * 100 AS VARCHAR) AS canonical, NULL AS subject FROM x
  UNION ALL SELECT o_orderkey, s, 'date', strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d'), NULL FROM x
  UNION ALL SELECT o_orderkey, s, 'percent', (o_custkey % 90 + 1) || '%', CAST((o_custkey % 90 + 1) * 100 AS VARCHAR), NULL FROM x
  UNION ALL SELECT o_orderkey, s, 'duration', (o_orderkey % 60 + 1) || ' days', CAST(o_orderkey % 60 + 1 AS VARCHAR), 'day' FROM x
  UNION ALL SELECT o_orderkey, s, 'section', 'Section ' || (o_custkey % 9 + 1) || '.' || (o_orderkey % 9 + 1), (o_custkey % 9 + 1) || '.' || (o_orderkey % 9 + 1), NULL FROM x
)
SELECT o_orderkey, type, text, CAST(strpos(s, CASE type WHEN 'percent' THEN 'of ' || text ELSE text END) - 1 + CASE type WHEN 'percent' THEN 3 ELSE 0 END AS INTEGER) AS start, canonical, subject FROM a
""")
def E4_E9_order_anchors(s, d):
    o = t(s, d, "orders")
    text = say(
        "Order K", F.col("o_orderkey"), " totals $", F.floor("o_totalprice").cast("long"), " and was placed on ", F.date_format("o_orderdate", "yyyy-MM-dd"), ". A fee of ", F.col("o_custkey") % 90 + 1,
        "% applies within ", F.col("o_orderkey") % 60 + 1, " days under Section ", F.col("o_custkey") % 9 + 1, ".", F.col("o_orderkey") % 9 + 1, ".",
    )
    return attest.anchor_rows(o.select("o_orderkey", text.alias("s")), "o_orderkey", "s").drop("end")


@q()
def E_anchors(s, d):
    return attest.anchor_rows(t(s, d, "documents"), "doc_id", "text")


@q(f"SELECT p_partkey, 'words_figures' AS detector, '{C}' AS verdict, ({WORDS!r})[p_size] || ' (' || (p_size + 1) || ')' AS detail FROM part WHERE p_partkey % 3 = 0")
def C1_words_figures(s, d):
    p, word = t(s, d, "part"), F.element_at(F.array(*map(F.lit, WORDS)), F.col("p_size").cast("int"))
    text = say("Deliver ", word, " (", F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0), ") pieces. Then ten (10) more.")
    return detect.words_figures(attest.sentences(p.select("p_partkey", text.alias("s")), "p_partkey", "s"), "p_partkey")


@q(f"""
WITH x AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(l_shipdate, '%Y-%m-%d') AS b, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS gap,
    abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) + CASE l_linenumber WHEN 2 THEN 40 WHEN 3 THEN 2 ELSE 0 END AS n
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
)
SELECT id, 'date_duration' AS detector, v AS verdict, a || ' ' || b || ' ' || n || ' days' AS detail FROM (
  SELECT *, CASE WHEN gap < 0 THEN '{C}' WHEN least(abs(n - gap), abs(n - gap - 1)) > 1 THEN '{C}' WHEN least(abs(n - gap), abs(n - gap - 1)) > 0 THEN '{R}' END AS v FROM x) WHERE v IS NOT NULL
""")
def C2_date_durations(s, d):
    j = t(s, d, "orders").select("o_orderkey", "o_orderdate").join(t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate"), "o_orderkey")
    a, b = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("l_shipdate", "yyyy-MM-dd")
    n = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))) + F.when(F.col("l_linenumber") == 2, 40).when(F.col("l_linenumber") == 3, 2).otherwise(0)
    rows = j.select((F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("id"), say("The term runs from ", a, " to ", b, ", in all ", n, " days.").alias("s"))
    return detect.date_durations(attest.sentences(rows, "id", "s"), "id")


@q(f"SELECT p_partkey, 'bound_pair' AS detector, '{C}' AS verdict, '$' || CAST(floor(p_retailprice) AS BIGINT) || ' > $' || p_size * 40 AS detail FROM part WHERE floor(p_retailprice) > p_size * 40")
def C3_bound_pairs(s, d):
    p = t(s, d, "part")
    text = say("A fee of at least $", F.floor("p_retailprice").cast("long"), " and at most $", F.col("p_size") * 40, " applies.")
    return detect.bound_pairs(attest.sentences(p.select("p_partkey", text.alias("s")), "p_partkey", "s"), "p_partkey")


@q(f"""
SELECT l_orderkey, 'list_count' AS detector, '{C}' AS verdict, 'declared ' || (count(*) + 1) || ' found ' || count(*) AS detail FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1
""")
def C4_list_counts(s, d):
    item = F.struct("l_linenumber", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("s"))
    g = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("i"))  # a few lines an order
    body = F.array_join(F.transform("i", lambda x, k: F.concat(F.lit("("), F.char(k + 97), F.lit(") "), x["s"])), "; ")
    text = say("The order has the following ", F.size("i") + F.when(F.col("l_orderkey") % 4 == 0, 1).otherwise(0), " items: ", body, ".")
    return detect.list_counts(g.select("l_orderkey", text.alias("s")), "l_orderkey", "s")


@q(f"SELECT o_orderkey, 'dangling_reference' AS detector, '{C}' AS verdict, (o_orderkey % 4 + 1) || '.' || (o_custkey % 3 + 1) AS detail FROM orders WHERE o_orderkey % 4 >= 2 AND (o_orderkey % 4 + 1) || '.' || (o_custkey % 3 + 1) <> '3.2'")
def C5_J20_dangling_references(s, d):
    ref = say(F.col("o_orderkey") % 4 + 1, ".", F.col("o_custkey") % 3 + 1)
    text = say("1. Scope\nThis is about orders.\n2. Terms\nAs provided in Section ", ref, " above, orders are paid.\n3.2 Notices\nNone.")
    return detect.dangling_references(t(s, d, "orders").select("o_orderkey", text.alias("s")), "o_orderkey", "s")


@q(f"SELECT c_custkey, 'clashing_definition' AS detector, '{C}' AS verdict, 'Segment' AS detail FROM customer WHERE c_mktsegment <> 'BUILDING'")
def C5_clashing_definitions(s, d):
    text = say('"Segment" means the building trade. Other words. In part two "Segment" means the ', F.lower("c_mktsegment"), " trade.")
    return detect.clashing_definitions(t(s, d, "customer").select("c_custkey", text.alias("s")), "c_custkey", "s")


@q(f"SELECT o_orderkey, 'time_conflict' AS detector, '{C}' AS verdict, 'Audit, Closing, Filing' AS detail FROM orders WHERE day(o_orderdate) + o_custkey % 5 > o_custkey % 31")
def C6_J18_time_conflicts(s, d):
    text = say(
        "Closing shall occur at least ", F.dayofmonth("o_orderdate"), " days after Filing. Audit must occur at least ", F.col("o_custkey") % 5, " days after Closing. Audit must occur no later than ", F.col("o_custkey") % 31, " days after Filing. Filing shall occur before Release.",
    )
    return detect.time_conflicts(t(s, d, "orders").select("o_orderkey", text.alias("s")), "o_orderkey", "s")


@q(f"""
SELECT o_orderkey, 'time_conflict' AS detector, CASE WHEN o_orderkey % 3 = 2 THEN '{R}' ELSE '{C}' END AS verdict, CASE o_orderkey % 3 WHEN 0 THEN 'Closing Date, Signing' WHEN 1 THEN 'Delivery, Signing' ELSE 'Closing Date' END AS detail
FROM orders WHERE o_orderkey % 3 <> 1 OR o_custkey % 4 > 1
""")
def C6_dated_time_conflicts(s, d):
    # a date a day too late for two weeks (0), months that can't be so few days (1), a date that can be read in two ways (2)
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 3
    late = F.date_format(F.date_add("o_orderdate", 15), "yyyy-MM-dd")
    text = F.when(k == 0, say("The Signing is on ", day, ". The Closing Date shall be held on ", late, ". The Closing Date must occur within two (2) weeks after the Signing.")).when(
        k == 1, say("The Delivery shall occur at least ", F.col("o_custkey") % 4, " months after the Signing. The Delivery must take place no later than 55 days after the Signing.")
    ).otherwise("The Closing Date is due on 03/04/2021. The Closing Date must fall before the Signing.")
    return detect.time_conflicts(t(s, d, "orders").select("o_orderkey", text.alias("s")), "o_orderkey", "s")


@q(f"""
WITH x AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(15, 2))) AS total FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT l_orderkey, 'footing' AS detector, '{C}' AS verdict, 'Total ' || CAST(CAST(total + 10 AS DECIMAL(34, 4)) AS VARCHAR) || ' items ' || CAST(CAST(total AS DECIMAL(34, 4)) AS VARCHAR) AS detail FROM x WHERE l_orderkey % 3 = 0
""")
def C7_A12_footing(s, d):
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    g = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", price.alias("p")))).alias("i"), F.sum(price).alias("total"))  # a few lines an order
    lines = F.array_join(F.transform("i", lambda x: F.concat(F.lit("Line item: "), x["p"].cast("string"))), "\n")
    text = say(lines, "\nTotal: ", F.col("total") + F.when(F.col("l_orderkey") % 3 == 0, F.lit(10)).otherwise(F.lit(0)))
    return detect.footing(g.select("l_orderkey", text.alias("s")), "l_orderkey", "s")


@q(f"""
SELECT p_partkey, 'fact' AS detector, CASE WHEN p_size % 5 = 0 THEN '{R}' ELSE '{C}' END AS verdict,
  'Price money_usd ' || least(CAST(p_size * 3500 AS VARCHAR), CAST(CAST(floor(p_retailprice) AS BIGINT) * 100 AS VARCHAR)) || ' ' || greatest(CAST(p_size * 3500 AS VARCHAR), CAST(CAST(floor(p_retailprice) AS BIGINT) * 100 AS VARCHAR)) AS detail
FROM part WHERE p_size * 35 <> floor(p_retailprice)
UNION ALL SELECT p_partkey, 'fact', '{R}', 'Term duration_days duration_months' FROM part WHERE p_partkey % 7 = 0
""")
def C8_A10_A11_facts(s, d):
    text = say(
        'The "Price" means ', F.when(F.col("p_size") % 5 == 0, "about ").otherwise(""), "$", F.col("p_size") * 35, '. Later the "Price" is $', F.floor("p_retailprice").cast("long"), '. The "Term" is 60 days. ',
        F.when(F.col("p_partkey") % 7 == 0, 'The "Term" is 2 months.').otherwise(""),
    )
    return detect.facts(t(s, d, "part").select("p_partkey", text.alias("s")), "p_partkey", "s")


@q(f"""
WITH x AS (SELECT p_brand, 'Load' AS term, CAST(p_size AS VARCHAR) || '000000000' AS v, p_partkey, false AS hedged FROM part
  UNION ALL SELECT p_brand, p_type, CAST(CAST(floor(p_retailprice) AS BIGINT) * 100 AS VARCHAR), p_partkey, p_size % 11 = 0 FROM part)
SELECT p_brand, 'fact_across' AS detector, CASE WHEN bool_or(hedged) THEN '{R}' ELSE '{C}' END AS verdict,
  term || CASE term WHEN 'Load' THEN ' quantity_mass ' ELSE ' money_usd ' END || min(v) || ' ' || max(v) AS detail
FROM x GROUP BY p_brand, term HAVING min(v) <> max(v) AND count(DISTINCT p_partkey) > 1
""")
def C9_J17_facts_across(s, d):
    p = t(s, d, "part")
    text = say('The "Load" is ', F.col("p_size"), ' kg. The "', F.col("p_type"), '" is ', F.when(F.col("p_size") % 11 == 0, "up to ").otherwise(""), "$", F.floor("p_retailprice").cast("long"), ".")
    return detect.facts_across(p.select("p_brand", "p_partkey", text.alias("s")), "p_brand", "p_partkey", "s")


_PLANTED = [
    ("Pay five (6) times.", "words_figures", C), ("It runs from 2021-01-01 to 2021-01-31, or 45 days.", "date_duration", C), ("A fee of at least $500 and at most $400 applies.", "bound_pair", C),
    ("Deliver the following three items: (a) one; (b) two.", "list_count", C), ("1. Scope\nAs in Section 3 above.\n2. Terms", "dangling_reference", C), ('"Fee" means the price. Later "Fee" means the cost.', "clashing_definition", C),
    ("Closing shall occur before Filing. Filing shall occur before Closing.", "time_conflict", C), ("Rent 100.00\nWater 20.50\nTotal 121.50", "footing", C), ('"Cap" means $500. The "Cap" is $600.', "fact", C),
    ('"Fee" means the price. The Fee is due. We pay the Late Charge and then the Late Charge again.', "undefined_term", R), ('"Fee" means the price.', "unused_term", R), ("All is well and 5 (5) of 5 agree.", None, None),
]


@q("SELECT o_orderkey, detector, verdict FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{n}', '{v}')" for i, (_, n, v) in enumerate(_PLANTED) if n) + f") AS p(i, detector, verdict) ON i = o_orderkey % {len(_PLANTED)}")
def C1_C8_planted_contradictions(s, d):
    """Each order's text holds the defect of one detector, or none."""
    text = F.get(F.array(*[F.lit(x) for x, _, _ in _PLANTED]), (F.col("o_orderkey") % len(_PLANTED)).cast("int"))
    return detect.scan(t(s, d, "orders").select("o_orderkey", text.alias("s")), "o_orderkey", "s").select("o_orderkey", "detector", "verdict")


@q("""
WITH c AS (SELECT l_orderkey, count(*) AS lines, bool_or(l_returnflag = 'R' AND l_linenumber <= 3) AS hit, count(*) FILTER (WHERE l_returnflag = 'R') AS expected, count(*) FILTER (WHERE l_discount > 0.05) AS cited,
  count(*) FILTER (WHERE l_discount > 0.05 AND l_returnflag = 'R') AS agreed, count(*) FILTER (WHERE l_tax > 0.06) AS dropped, count(*) FILTER (WHERE l_tax < 0.02) AS repaired, count(*) FILTER (WHERE l_linestatus = 'F') AS valid FROM lineitem GROUP BY 1)
SELECT o_orderpriority AS grp, count(*) AS cases, count(*) FILTER (WHERE hit) AS hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS hit_rate, round(avg(CASE WHEN cited > 0 THEN agreed::DOUBLE / cited ELSE 0 END), 4) AS citation_precision,
  round(avg(CASE WHEN expected > 0 THEN agreed::DOUBLE / expected ELSE 0 END), 4) AS citation_recall, round(sum(valid)::DOUBLE / sum(lines), 4) AS quote_validity, round(sum(dropped)::DOUBLE / sum(lines), 4) AS drop_rate, round(sum(repaired)::DOUBLE / sum(lines), 4) AS repair_rate
FROM orders LEFT JOIN c ON o_orderkey = l_orderkey GROUP BY 1
""")
def A16_evaluation_metrics(s, d):
    """Orders as cases: lines in their order are what was retrieved, returned ones what was expected, discounted ones what was cited."""
    li, o = t(s, d, "lineitem"), t(s, d, "orders").select(F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("grp"))
    rows = li.select(
        F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") == "R").alias("expected"), (F.col("l_discount") > 0.05).alias("cited"), (F.col("l_tax") > 0.06).alias("dropped"),
        (F.col("l_tax") < 0.02).alias("repaired"), (F.col("l_linestatus") == "F").alias("valid"),
    )
    return evaluation(rows, o, 3)


@q("""
SELECT o_orderkey, type, canonical FROM (SELECT o_orderkey, o_orderkey % 40 + 1 AS a, o_custkey % 900 + 100 AS b FROM orders) x, LATERAL (VALUES
  ('citation', a || ' f.3d ' || b), ('slip_op', 'slip op.'), ('quote', NULL), ('magnitude', b || '000000'), ('money', CAST(a * 500 AS VARCHAR)), ('money', '50000000'), ('quantity', b || '000000000'), ('count', '12' || b), ('party', 'acme corp'), ('duration', CAST(a * 30 AS VARCHAR))) AS v(type, canonical)
""")
def E_planted_anchors(s, d):
    """One sentence of each order with ten typed values."""
    a, b = F.col("o_orderkey") % 40 + 1, F.col("o_custkey") % 900 + 100
    text = say(
        "as held in ", a, " F.3d ", b, " and slip op. there, “no words” cost ", b, " million units and $", a * 5, " or five hundred thousand dollars for ", b, " kg of 12,", b, " grains from Acme Corp. within ", a, " months",
    )
    # few sentences differ: each one is read once
    return once_per_text(t(s, d, "orders").select("o_orderkey", text.alias("s")), "o_orderkey", "s", attest.anchor_rows).select("o_orderkey", "type", "canonical")


@q(f"""
SELECT o_orderkey, '{C}' AS verdict, CAST((o_orderkey % 3 = 0) AS INT)::BIGINT + (o_custkey % 2)::BIGINT AS n FROM orders WHERE o_orderkey % 3 = 0 OR o_custkey % 2 = 1
UNION ALL SELECT o_orderkey, '{R}', 1 FROM orders
""")
def C10_findings_by_verdict(s, d):
    text = say(
        "Deliver five (", F.when(F.col("o_orderkey") % 3 == 0, "6").otherwise("5"), ") pieces for at least $", F.when(F.col("o_custkey") % 2 == 1, "900").otherwise("100"), " and at most $500. ",
        '"Fee" means the price.\nRent 10.00\nWater 2.50\nTotal 12.50',
    )
    return detect.scan(t(s, d, "orders").select("o_orderkey", text.alias("s")), "o_orderkey", "s").groupBy("o_orderkey", "verdict").agg(F.count("*").alias("n"))
