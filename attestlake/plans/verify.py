"""Verification of claims that are built from orders, each against its own order's sources, so that SQL knows the outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestlake.functions import text as X
from attestlake.operators import claims as C
from attestlake.operators import verify as V
from attestlake.plans.base import Book, t
from attestlake.plans.detectors import say

q = Book()
QUERIES, ORACLE = q.queries, q.oracle


def K():
    return F.col("o_orderkey")


def M():
    return F.col("o_orderkey") % 3


def sentences(s, d):
    """o_orderkey, sentence_id, sentence: three sentences of each order."""
    o = t(s, d, "orders")
    one = say("Order K", K(), " totals $", F.floor("o_totalprice").cast("long"), " and was placed on ", F.date_format("o_orderdate", "yyyy-MM-dd"), " by Customer.")
    two = say("Its priority class is ", F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")), " and the parcel ships within ", F.col("o_custkey") % 50 + 2, " days.")
    three = F.lit("The seller shall deliver the parcel to the northern warehouse of Rotterdam.")
    return o.select("o_orderkey", F.posexplode(F.array(one, two, three)).alias("sentence_id", "sentence"))


def claims(s, d):
    """Claims by order key modulo 3. 0: the amount altered, the delivery negated; 1: word for word; 2: another town, and nothing to check."""
    o = t(s, d, "orders")
    one = say("Order K", K(), " totals $", F.floor("o_totalprice").cast("long") + F.when(M() == 0, 7).otherwise(0), " and was placed on ", F.date_format("o_orderdate", "yyyy-MM-dd"), " by Customer.")
    two = F.when(M() == 0, F.lit("The seller shall not deliver the parcel to the northern warehouse of Rotterdam.")).when(M() == 1, F.lit("The seller shall deliver the parcel to the northern warehouse of Rotterdam.")).otherwise(
        F.lit("The seller shall deliver the parcel to the northern warehouse of Hamburg."))
    three = F.lit("Nobody quite remembers that winter afternoon.")
    return o.select("o_orderkey", F.posexplode(F.when(M() == 2, F.array(two, three)).otherwise(F.array(one, two))).alias("claim_id", "claim"))


@q("""
SELECT o_orderkey, 0 AS claim_id, 2 AS n FROM orders WHERE o_orderkey % 3 = -1
UNION ALL SELECT o_orderkey, c, CAST(n AS INT) FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 3 = 2 THEN [0] ELSE [0, 1] END) AS c FROM orders) JOIN (SELECT 0 AS dummy) ON true
JOIN LATERAL (SELECT CASE WHEN o_orderkey % 3 = 2 OR c = 1 THEN 2 ELSE 1 END AS n) ON true
""")
def J13_V2_candidates(s, d):
    # a claim about the amount meets its one sentence; one about the parcel meets the two that name a parcel
    return V.candidates(claims(s, d), sentences(s, d), "o_orderkey").groupBy("o_orderkey", "claim_id").agg(F.count("*").cast("int").alias("n"))


@q("""
WITH w AS (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 3 = 2 THEN [0, 1] ELSE [0, 1] END) AS claim_id FROM orders)
SELECT 'all' AS pool, CAST(o_orderkey * 2 + claim_id AS BIGINT) AS claim_id, NOT (o_orderkey % 3 = 2 AND claim_id = 1) AS refused FROM w
""")
def V14_shared_pool_refuses(s, d):
    # in one pool for all orders each claim but the last kind shares words with every order's sentences
    pool = lambda df, i: df.select(F.lit("all").alias("pool"), (F.col("o_orderkey") * 2 + F.col(i)).alias(i), *[c for c in df.columns if c not in ("o_orderkey", i)])
    return V.over_bounds(pool(claims(s, d), "claim_id"), pool(sentences(s, d), "sentence_id"), "pool", most=1000, most_in_all=10**12).drop("n")


@q("SELECT o_orderkey, 0 AS claim_id, CASE WHEN o_orderkey % 3 = 0 THEN 'altered' ELSE 'verified' END AS state FROM orders WHERE o_orderkey % 3 < 2")
def V10_J16_residue(s, d):
    return V.residue(claims(s, d), sentences(s, d), "o_orderkey")


@q("""
SELECT o_orderkey, 1 AS claim_id, 2 AS sentence_id, CASE WHEN o_orderkey % 3 = 0 THEN 'negation' ELSE 'restated' END AS kind FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, 0, 2, 'name' FROM orders WHERE o_orderkey % 3 = 2
UNION ALL SELECT o_orderkey, 0, 0, CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE 'restated' END FROM orders WHERE o_orderkey % 3 < 2
""")
def V11_J15_near_copies(s, d):
    return V.flips(claims(s, d), sentences(s, d), "o_orderkey").drop("name")


_STATES = """(SELECT o_orderkey, 0 AS claim_id, CASE WHEN o_orderkey % 3 = 1 THEN 'verified' ELSE 'altered' END AS state FROM orders UNION ALL
  SELECT o_orderkey, 1, CASE o_orderkey % 3 WHEN 0 THEN 'altered' WHEN 1 THEN 'verified' ELSE 'could_not_check' END FROM orders)"""


@q(f"SELECT * FROM {_STATES}")
def V12_claim_states(s, d):
    return C.attested(claims(s, d), C.source_index(sentences(s, d), "o_orderkey"))


@q(f"""
SELECT o_orderkey, count(*) AS n_claims, count(*) FILTER (WHERE state = 'verified') AS n_verified, CASE WHEN bool_or(state = 'altered') THEN 'altered' WHEN bool_or(state = 'could_not_check') THEN 'could_not_check' ELSE 'verified' END AS state FROM {_STATES} GROUP BY 1
""")
def V13_A8_attested_drafts(s, d):
    return C.folded(C.attested(claims(s, d), C.source_index(sentences(s, d), "o_orderkey")), "o_orderkey")


_LEGS = ["verified", "altered", "could_not_check", "altered", "altered", "altered", "altered", "altered", "could_not_check", "altered", "altered", "verified", "altered", "could_not_check", "could_not_check", "could_not_check", "could_not_check"]


def one_leg_each(s, d):
    """(claims, sentences, sources): for each order a claim that one leg alone decides, by its key modulo 17, in the order of _LEGS."""
    o, k = t(s, d, "orders"), F.col("o_orderkey") % 17
    n = (F.floor("o_totalprice").cast("long") + 10_000).cast("string")
    more = (F.floor("o_totalprice").cast("long") + 10_001).cast("string")
    by_case = lambda rows: F.element_at(F.array(*rows), (k + 1).cast("int"))
    lit = F.lit
    claim = by_case([
        say("The deposit of $", n, " is held by the bank."),  # 0: restated
        say("A deposit of $", n, " goes to the bank."),  # 1: another amount, other words
        say("A deposit of $", n, " goes to the bank."),  # 2: as 1, but another sentence carries the amount
        say("The parcel of Order K", K(), " leaves on 2021-05-06."),  # 3: another date
        say("For Order K", K(), " the northern warehouse keeps 12 boxes and 13 crates at $", n, " in all."),  # 4: a near copy with several figures
        lit("Widgets come under an exclusive license."),  # 5: polarity
        lit("This sale is governed by the laws of Texas."),  # 6: law
        say("The tank holds ", n, " liters of oil."),  # 7: residue
        say("The tank holds ", n, " liters of oil."),  # 8: residue, confirmed and denied
        lit("the parcel shall not be returned to the old northern store"),  # 9: a near copy without anchors
        lit("They say “paid in full by the second buyer” there."),  # 10: a quote in no source
        lit("They say “paid in full by the second buyer” there."),  # 11: a quote in a sentence
        lit("The fee is 5% Interest and 7% Commission."),  # 12: percentages by subject
        say("The break fee is $", n, "."),  # 13: another amount of another matter
        say("A deposit of $", n, " goes to the bank."),  # 14: the amount alone is located
        lit("the parcel goes to Rotterdam by the old northern road"),  # 15: another name, which stands elsewhere
        lit("nobody remembers that winter afternoon"),  # 16: nothing to check
    ])
    first = by_case([
        say("The deposit of $", n, " is held by the bank."), say("The deposit at signing: $", more, "."), say("The deposit at signing: $", more, "."), lit("The parcel leaves the dock on 2021-05-07."),
        say("For Order K", K(), " the northern warehouse keeps 12 boxes and 13 crates at $", more, " in all."), lit("Widgets come under a non-exclusive license of some kind."), lit("The laws of Ohio govern this sale."),
        say("The tank holds ", more, " liters of oil."), say("The tank holds ", more, " liters of oil."), lit("the parcel shall be returned to the old northern store"), lit("It was never paid."),
        lit("The clerk wrote that it was paid in full by the second buyer."), lit("The fee: 6% Interest and 7% Commission."), say("Marketing budget: $", more, "."), say("The deposit at signing: $", n, "."),
        lit("the parcel goes to Hamburg by the old northern road"), lit("The fee is due."),
    ])
    second = by_case([lit("It rains.")] * 2 + [say("Later the bank had $", n, " in store.")] + [lit("It rains.")] * 5 + [say("The tank holds ", n, " liters of oil.")] + [lit("It rains.")] * 6 + [lit("Some rooms in Rotterdam are free.")] + [lit("It rains.")])
    sentences_ = o.select("o_orderkey", F.posexplode(F.array(first, second)).alias("sentence_id", "sentence"))
    sources = o.select("o_orderkey", lit(0).alias("source_id"), F.concat_ws(" ", first, second).alias("text"), lit(True).alias("complete"))
    return o.select("o_orderkey", lit(0).alias("claim_id"), claim.alias("claim")), sentences_, sources


@q(f"SELECT o_orderkey, 0 AS claim_id, ({_LEGS})[o_orderkey % 17 + 1] AS state FROM orders")
def V12_one_leg_decides(s, d):
    c, x, sources = one_leg_each(s, d)
    return C.attested(c, C.source_index(x, "o_orderkey"), sources)


@q("""
SELECT CASE WHEN starts_with(key, 't:') THEN 't' ELSE 's' END AS kind, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_postings FROM (
  SELECT o_orderkey, 't:' || w AS key, 1 AS n FROM (SELECT o_orderkey, unnest(['order', 'placed', 'customer']) AS w FROM orders)
  UNION ALL SELECT o_orderkey, 's:' || i, 1 FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS i FROM orders)
) GROUP BY 1
""")
def V1_source_index(s, d):
    # the lists of the words of each order's first sentence, and of the skeletons of all
    keys = C.source_index(sentences(s, d), "o_orderkey").lengths.where("key IN ('t:order', 't:placed', 't:customer') OR startswith(key, 's:')")
    return keys.groupBy(F.substring("key", 1, 1).alias("kind")).agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_postings"))


@q("""
WITH x AS (SELECT c_custkey, 'Dr. Who of ' || c_name || ' said it' AS a, 'was paid.' AS b, 'It rained.' AS c, 'Terms of Sale' AS h, 'all sales of' AS e, c_mktsegment || ' goods stand. Bye.' AS f FROM customer)
SELECT c_custkey, grp, n, CAST(start AS INT) AS start, true AS sliced FROM (
  SELECT c_custkey, 0 AS grp, 2 AS n, 0 AS start FROM x UNION ALL SELECT c_custkey, 1, 1, length(a) + 1 + length(b) + 1 FROM x
  UNION ALL SELECT c_custkey, 2, 1, length(a) + length(b) + length(c) + 4 FROM x UNION ALL SELECT c_custkey, 3, 2, length(a) + length(b) + length(c) + length(h) + 5 FROM x
  UNION ALL SELECT c_custkey, 4, 1, length(a) + length(b) + length(c) + length(h) + length(e) + length(f) + 2 FROM x)
""")
def X9_logical_sentences(s, d):
    """A wrapped sentence, one more on its line, a heading after a blank line, again a wrapped one and a last one."""
    text = F.concat(F.lit("Dr. Who of "), "c_name", F.lit(" said it\nwas paid. It rained.\n\nTerms of Sale\nall sales of\n"), "c_mktsegment", F.lit(" goods stand. Bye."))
    c = t(s, d, "customer").select("c_custkey", text.alias("body"))
    x = c.select("c_custkey", "body", F.explode(X.logical_sentences("body")).alias("s"))
    same = F.substr("body", F.col("s.start") + 1, F.length("s.sentence")) == F.col("s.sentence")
    g = x.groupBy("c_custkey", F.col("s.group").alias("grp"))
    return g.agg(F.count("*").cast("int").alias("n"), F.min("s.start").alias("start"), F.min(same).alias("sliced"))


@q("""
WITH x AS (SELECT l_orderkey, count(*) AS n, l_orderkey % 3 AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, route, state, count(*) AS n FROM (
  SELECT l_orderkey, 'none' AS route, 'untreated' AS state FROM x
  UNION ALL SELECT l_orderkey, 'anchors', CASE m WHEN 0 THEN 'altered' WHEN 1 THEN 'verified' ELSE 'could_not_check' END FROM x
  UNION ALL SELECT l_orderkey, 'citation', CASE WHEN l_orderkey % 5 = 0 THEN 'altered' ELSE 'verified' END FROM x
  UNION ALL SELECT l_orderkey, 'citation', CASE WHEN l_orderkey % 5 = 0 THEN 'altered' ELSE 'verified' END FROM x
  UNION ALL SELECT l_orderkey, 'quote', CASE WHEN m = 1 THEN 'altered' ELSE 'verified' END FROM x
) GROUP BY ALL
""")
def V20_envelope(s, d):
    """Drafts of five sentences on each order of lineitem: nothing to check, an amount, a quote that wraps onto its citation, and a quote."""
    g = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    k, n = F.col("l_orderkey"), F.col("n")
    amount = say("The buyer owes $", k + 1000 + F.when(k % 3 == 0, 1).otherwise(0), " for the lines.")
    cite = say(k % 40, " F.3d ", k % 5 + 1)
    draft = say("nobody remembers that winter.\n", amount, "\nThe court wrote “paid in full by the buyer” as it\nsays in ", cite, " of that year.\nThe clerk said “", F.when(k % 3 == 1, "sent on time to the wrong place").otherwise("sent on time to the right place"), "” that day.")
    body = [F.when(k % 3 == 2, F.lit("The buyer owes a sum for the lines.")).otherwise(say("The buyer owes $", k + 1000, " for the lines.")), F.lit("It was sent on time to the right place as agreed.")]
    x = g.select("l_orderkey", F.posexplode(F.array(*body)).alias("sentence_id", "sentence"))
    src = g.select("l_orderkey", F.lit(0).alias("source_id"), F.concat_ws(" ", *body).alias("text"), F.lit(True).alias("complete"))
    cases = g.where(k % 5 > 0).select(cite.alias("cite"))
    out = C.envelope(g.select("l_orderkey", draft.alias("draft")), x, src, cases, "l_orderkey", complete=True)
    return out.groupBy("l_orderkey", "route", "state").agg(F.count("*").alias("n"))


_CASE = "o_orderkey % 8"


def clauses(s, d):
    """o_orderkey, claim, clause: a clause that is equal (0), or has another date (1), another amount (2), no law (3), two dates (4), a place around the claim's (5), another polarity (6), no figure at all (7)."""
    o, k = t(s, d, "orders"), F.col("o_orderkey") % 8
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")
    amount = F.floor("o_totalprice").cast("long")
    tail = lambda law, non: F.concat(F.lit(" The "), non, F.lit("exclusive license is governed by the laws of "), law, F.lit("."))
    claim = say("A fee of $", amount, " is due on ", day, ".", tail(F.lit("England"), F.lit("")))
    law = F.when(k == 5, "the United Kingdom").otherwise("England")
    clause = F.when(k == 7, F.lit("Nothing is said here.")).otherwise(say(
        "The fee of $", amount + F.when(k == 2, 1).otherwise(0), " shall be paid on ", F.when(k == 1, later).otherwise(day), F.when(k == 4, F.concat(F.lit(" or on "), later)).otherwise(""), ".",
        F.when(k == 3, F.lit(" The exclusive license stands.")).otherwise(tail(law, F.when(k == 6, "non-").otherwise(""))),
    ))
    return o.select("o_orderkey", claim.alias("claim"), clause.alias("clause"))


@q(f"SELECT o_orderkey, (['present', 'contradiction', 'contradiction', 'unconfirmed', 'multi_value', 'multi_value', 'contradiction', 'unconfirmed'])[{_CASE} + 1] AS disposition FROM orders")
def V5_V7_clause_verdicts(s, d):
    return V.compared(clauses(s, d)).select("o_orderkey", V.disposition(F.col("results")).alias("disposition"))


@q("SELECT o_custkey, CASE WHEN bool_or(x IN (1, 2, 6)) AND bool_or(x NOT IN (1, 2, 6, 7)) THEN 'mixed' ELSE 'plain' END AS kind, count(*) AS n FROM (SELECT *, o_orderkey % 8 AS x FROM orders) GROUP BY 1")
def V9_customers_with_mixed_clauses(s, d):
    x = t(s, d, "orders").select("o_custkey", (F.col("o_orderkey") % 8).alias("x"))
    g = x.groupBy("o_custkey").agg(F.max(F.col("x").isin(1, 2, 6)).alias("a"), F.max(~F.col("x").isin(1, 2, 6, 7)).alias("b"), F.count("*").alias("n"))
    return g.select("o_custkey", F.when(F.col("a") & F.col("b"), "mixed").otherwise("plain").alias("kind"), "n")


@q("""
WITH c AS (SELECT l_orderkey, bool_or(l_linenumber % 3 = 0) AS equal, bool_or(l_linenumber % 3 = 1) AS differ, bool_or(l_linenumber % 3 = 2) AS silent FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN differ AND equal THEN 'conflicting_clauses' WHEN differ THEN 'contradiction' WHEN equal THEN 'present' ELSE 'not_found' END AS disposition FROM c
""")
def V9_adjudicated_clauses(s, d):
    # an order's lines are its candidate clauses: every third one carries the claim's date, every third one another
    li, k = t(s, d, "lineitem"), F.col("l_linenumber") % 3
    day = F.lit("The parcel is due on 2021-05-06.")
    clause = F.when(k == 0, day).when(k == 1, F.lit("The parcel is due on 2021-05-07.")).otherwise("The parcel is due at some time.")
    return V.adjudicated(V.compared(li.select("l_orderkey", day.alias("claim"), clause.alias("clause"))), ["l_orderkey"])


@q("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ['$' || (p_size + 900)] ELSE [] END AS altered FROM part WHERE p_size % 3 < 2 ")
def V6_X20_altered_figures(s, d):
    p = t(s, d, "part").where("p_size % 3 < 2")
    said = lambda n: say("The widget number 77 of this long standing order costs $", n, " and is sold in packs.")
    pairs = p.select("p_partkey", said(F.col("p_size") + 900).alias("claim"), said(F.col("p_size") + F.when(F.col("p_size") % 3 == 0, 901).otherwise(900)).alias("clause"))
    return V.altered_figures(pairs).select("p_partkey", "altered")


@q("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'present' ELSE 'not_found' END AS subjects FROM customer")
def V8_percent_subjects(s, d):
    c, k = t(s, d, "customer"), F.col("c_custkey")
    claim = say("Pay ", k % 40 + 1, "% Interest on the sum.")
    clause = F.when(k % 3 == 2, say("Pay ", k % 40 + 1, "% Commission.")).otherwise(say("The rate is ", k % 40 + 1 + F.when(k % 3 == 0, 1).otherwise(0), "% Interest a year."))
    return V.percent_subjects(c.select("c_custkey", claim.alias("claim"), clause.alias("clause"))).select("c_custkey", "subjects")


@q("""
SELECT o_orderkey, 0 AS claim_id, CASE WHEN o_orderkey % 4 = 2 THEN 'paid at once [...] on ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'paid at once on ' || strftime(o_orderdate, '%Y-%m-%d') END AS quote,
  CASE o_orderkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'altered' WHEN 2 THEN 'verified' ELSE 'could_not_check' END AS state FROM orders
""")
def V3_X16_X17_quote_states(s, d):
    o, k = t(s, d, "orders"), F.col("o_orderkey") % 4
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    quote = F.when(k == 2, say("paid at once [...] on ", day)).otherwise(say("paid at once on ", day))
    c = o.select("o_orderkey", F.lit(0).alias("claim_id"), say('It says “', quote, '” there.').alias("claim"))
    body = say("The fee was ", F.when(k.isin(0, 2), "Paid at once").otherwise("paid later"), F.when(k == 2, ", as agreed").otherwise(""), " on ", day, ".")
    src = o.select("o_orderkey", F.lit(1).alias("source_id"), F.when(k == 0, F.replace(body, F.lit("Paid"), F.lit("paid"))).otherwise(body).alias("text"), (k != 3).alias("complete"))
    return V.quote_states(c, src, "o_orderkey")


@q("SELECT o_orderkey, 0 AS claim_id, CASE WHEN o_orderkey % 3 = 0 THEN 12 END AS start FROM orders")
def V17_W11_placement(s, d):
    o = t(s, d, "orders")
    claim = say("Order K", K(), " was paid.")
    draft = F.concat(F.lit("Some  words. "), F.when(M() == 1, F.lit("")).otherwise(F.upper(claim)), F.lit(" And more. "), F.when(M() == 2, claim).otherwise(""))
    return V.placed(o.select("o_orderkey", F.lit(0).alias("claim_id"), claim.alias("claim")), o.select("o_orderkey", draft.alias("draft")), "o_orderkey")


@q("SELECT o_orderkey, (o_custkey % 9 + 1) || '.2' AS section FROM orders WHERE o_orderkey % 3 = 0")
def V18_ungrounded_sections(s, d):
    o = t(s, d, "orders")
    draft = say("As Section ", F.col("o_custkey") % 9 + 1, ".2 and Section 12 say.")
    src = say("Under Section 12", F.when(M() == 1, F.concat(F.lit(" and Section "), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit(".2"))).otherwise(""), ".")
    return V.ungrounded_sections(o.select("o_orderkey", draft.alias("draft")), o.select("o_orderkey", F.when(M() == 2, "No numbers.").otherwise(src).alias("text")), "o_orderkey")


@q("""
SELECT c_custkey, 'Rotterdam' AS term FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, CAST(c_custkey + 5000 AS VARCHAR) FROM customer WHERE c_custkey % 4 <> 1
""")
def V21_fabricated_terms(s, d):
    c, k = t(s, d, "customer"), F.col("c_custkey")
    number = F.format_number(k + 5000, 0)
    draft = say("The parcel went to Rotterdam for ", number, " coins in Spring.")
    src = say("In Spring it went to ", F.when(k % 4 == 0, "Hamburg").otherwise("Rotterdam"), F.when(k % 4 == 1, F.concat(F.lit(" for "), (k + 5000).cast("string"))).otherwise(""), ".")
    return V.fabricated_terms(c.select("c_custkey", draft.alias("draft")), c.select("c_custkey", src.alias("text")), "c_custkey")


@q("""
WITH a AS (SELECT doc_id AS k, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda x: lower(x))) AS t FROM documents), b AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda x: lower(x))) AS t FROM benchmark),
j AS (SELECT item_id, k, round(len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS jac FROM a, b WHERE len(list_intersect(a.t, b.t)) > 0)
SELECT 'all' AS scope, item_id AS claim_id, k AS sentence_id, jac AS jaccard FROM j WHERE jac >= 0.1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY jac DESC, k) = 1
""")
def V22_U5_best_spans(s, d):
    scope = F.lit("all").alias("scope")
    return V.best_spans(t(s, d, "benchmark").select(scope, F.col("item_id").alias("claim_id"), F.col("text").alias("claim")), t(s, d, "documents").select(scope, F.col("doc_id").alias("sentence_id"), F.col("text").alias("sentence")), "scope")


@q("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey % 40 || ' F.3d ' || l_partkey AS cite FROM lineitem), k AS (SELECT DISTINCT s_suppkey % 40 || ' F.3d ' || p_partkey AS cite, p_brand FROM supplier JOIN part ON p_partkey % 3 = s_suppkey % 3)
SELECT l_orderkey, l_linenumber, cite, EXISTS (SELECT 1 FROM k WHERE k.cite = c.cite) AS known FROM c
""")
def V24_J22_citation_lookup(s, d):
    # the citations of texts against the clusters that exist: an equi-join on the normalized cite
    from attestlake.functions import anchors as A

    text = say("As held in ", F.col("l_suppkey") % 40, " F.3d  ", F.col("l_partkey"), ", it stands.")
    found = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(A.figures(text)).alias("a")).where("a.type = 'citation'")
    # the clusters: a part's page in the volume of each supplier of its class; volumes first, so that no supplier meets a part twice
    volumes = t(s, d, "supplier").select((F.col("s_suppkey") % 40).alias("volume"), (F.col("s_suppkey") % 3).alias("m")).distinct()
    parts = t(s, d, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("m")).distinct()
    known = parts.join(F.broadcast(volumes), "m").select(F.lower(say(F.col("volume"), " F.3d ", F.col("p_partkey"))).alias("key"))
    j = found.withColumn("key", F.col("a.canonical")).join(known.withColumn("known", F.lit(True)), "key", "left")
    return j.select("l_orderkey", "l_linenumber", F.regexp_replace("a.text", r"\s+", " ").alias("cite"), F.coalesce("known", F.lit(False)).alias("known"))


@q("""
WITH x AS (SELECT conv_id, turn, text, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations), r AS (SELECT *, substr(source, 1, 12) AS quote FROM x WHERE role = 'assistant')
SELECT conv_id, count(*) AS attempts, count(*) FILTER (WHERE source IS NULL) AS no_source, count(*) FILTER (WHERE source IS NOT NULL AND trim(quote) = '') AS empty_quotes, count(*) FILTER (WHERE trim(quote) <> '' AND contains(text, quote)) AS kept,
  count(*) FILTER (WHERE trim(quote) <> '' AND NOT contains(text, quote) AND contains(lower(text), lower(split_part(quote, ' ', 1)))) AS repaired FROM r GROUP BY 1
""")
def V25_grounded_answer_counters(s, d):
    from pyspark.sql.window import Window

    x = t(s, d, "conversations").withColumn("source", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'").withColumn("quote", F.substring("source", 1, 12))
    full = F.trim("quote") != ""
    held = F.contains("text", "quote")
    first = F.contains(F.lower("text"), F.lower(F.substring_index("quote", " ", 1)))
    return x.groupBy("conv_id").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("source").isNull()).alias("no_source"), F.count_if(F.col("source").isNotNull() & ~full).alias("empty_quotes"), F.count_if(full & held).alias("kept"),
        F.count_if(full & ~held & first).alias("repaired"),
    )


@q("SELECT p_partkey, 'unused_term' AS kind, 'Widget Rule' AS detail FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'percent_clash', 'interest 500 600' FROM part WHERE p_partkey % 3 = 0")
def V19_structural_checks(s, d):
    k = F.col("p_partkey")
    text = say('"Widget Rule" means a rule. ', F.when(k % 2 == 1, "The Widget Rule holds. ").otherwise(""), "Pay 5% Interest now. ", F.when(k % 3 == 0, "Pay 6% Interest later.").otherwise("Pay 5% Interest later."))
    return structural(t(s, d, "part").select("p_partkey", text.alias("s")), "p_partkey", "s")


def structural(docs, id_, text):
    """Id, kind, detail: terms that a text defines and doesn't use again, and percentages of one subject that differ."""
    from attestlake.functions import anchors as A

    terms = docs.select(id_, text, F.explode(A.defined_terms(text)).alias("term"))
    unused = terms.where(F.size(A.uses_of(F.col(text), F.col("term"))) < 2).select(id_, F.lit("unused_term").alias("kind"), F.col("term").alias("detail"))
    p = docs.select(id_, F.explode(A.figures(text)).alias("a")).where("a.type = 'percent' AND a.subject IS NOT NULL")
    g = p.groupBy(id_, F.lower("a.subject").alias("s")).agg(F.min("a.canonical").alias("lo"), F.max("a.canonical").alias("hi")).where("lo <> hi")
    return unused.unionByName(g.select(id_, F.lit("percent_clash").alias("kind"), F.concat_ws(" ", "s", "lo", "hi").alias("detail")))


@q("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'the “Order K' || o_orderkey || '” was paid at the northern warehouse' END AS repaired, CASE WHEN o_orderkey % 3 = 2 THEN 'altered' ELSE 'verbatim' END AS last_kind FROM orders
""")
def X15_V4_quote_repairs(s, d):
    # typographic marks, spaces and case differ (0), or nothing does (1), or the words do (2)
    own = say("the “Order K", K(), "” was paid at the northern warehouse")
    quote = F.when(M() == 0, say('The "order K', K(), '"  was paid at the northern warehouse')).when(M() == 1, own).otherwise("some other words that nobody ever wrote")
    pairs = t(s, d, "orders").select("o_orderkey", quote.alias("quote"), F.concat(F.lit("We heard that "), own, F.lit(" as agreed.")).alias("source"))
    x = V.quote_autopsy(V.quote_repairs(pairs, "quote", "source"), "quote", "source")
    return x.select("o_orderkey", "repaired", F.element_at("segments", -1)["kind"].alias("last_kind"))
