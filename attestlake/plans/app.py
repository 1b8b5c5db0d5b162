"""Learning analytics: cards, reviews, mastery, momentum, notes, citations.

Orders stand for cards (a customer's, due on their date unless open), line items for their citations, events for reviews
(user by user), conversations for tutor sessions.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestlake.functions import text as X
from attestlake.operators import relational as R
from attestlake.plans.base import Book, t

q = Book()
QUERIES, ORACLE = q.queries, q.oracle
TODAY = "1997-01-01"
_DUE = f"(o_orderstatus = 'O' OR o_orderdate <= TIMESTAMP '{TODAY}')"
_CARD_DUE = "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END"


def cards(s, d):
    """Orders as cards: card, owner, due (null: never reviewed), price."""
    return t(s, d, "orders").select(F.col("o_orderkey").alias("card"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("due"), "o_totalprice", "o_orderpriority")


def due(c):
    return c.where(R.is_due(F.col("due"), F.lit(TODAY).cast("timestamp")))


@q(f"""
WITH l AS (SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS part, max(l_linenumber) AS line FROM lineitem GROUP BY 1)
SELECT o_orderkey AS card, c_name, line, p_name AS citation FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = part
WHERE {_CARD_DUE} IS NULL OR {_CARD_DUE} <= TIMESTAMP '{TODAY}'
""")
def P1_due_cards_latest_citation(s, d):
    last = R.latest_row(t(s, d, "lineitem").select(F.col("l_orderkey").alias("card"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p_partkey")), ["card"], ["line", "p_partkey"])
    c = due(cards(s, d)).join(t(s, d, "customer").select(F.col("c_custkey").alias("owner"), "c_name"), "owner").join(last, "card", "left")
    return c.join(t(s, d, "part").select("p_partkey", F.col("p_name").alias("citation")), "p_partkey", "left").select("card", "c_name", "line", "citation")


@q("""
WITH h AS (SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE contains(lower(p_name), 'e') AND p_size >= 10)
SELECT * FROM h ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20
""")
def P2_card_search_page(s, d):
    hits = t(s, d, "part").where(F.contains(F.lower("p_name"), F.lit("e")) & (F.col("p_size") >= 10)).select("p_partkey", "p_name")
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy("p_name", "p_partkey").offset(20).limit(20).join(F.broadcast(total))  # one row


@q(f"SELECT c_mktsegment AS subject, count(*) AS cards, count(*) FILTER (WHERE {_CARD_DUE} IS NULL OR {_CARD_DUE} <= TIMESTAMP '{TODAY}') AS due, count(*) FILTER (WHERE {_CARD_DUE} IS NULL) AS fresh FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def P3_subject_card_counts(s, d):
    c = cards(s, d).join(t(s, d, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("subject")), "owner")
    is_due = R.is_due(F.col("due"), F.lit(TODAY).cast("timestamp"))
    return c.groupBy("subject").agg(F.count("*").alias("cards"), F.count_if(is_due).alias("due"), F.count_if(F.col("due").isNull()).alias("fresh"))


@q(f"""
WITH e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS outcome, max(ts) AS seen FROM events GROUP BY 1)
SELECT o_orderkey AS card, o_custkey AS owner, outcome, seen, row_number() OVER (PARTITION BY o_custkey ORDER BY {_CARD_DUE} NULLS FIRST, o_orderkey) AS place
FROM orders LEFT JOIN e ON user_id = o_custkey WHERE {_CARD_DUE} IS NULL OR {_CARD_DUE} <= TIMESTAMP '{TODAY}'
""")
def P4_review_queue(s, d):
    last = R.latest_row(t(s, d, "events").select(F.col("user_id").alias("owner"), "ts", "event_id", F.col("event_type").alias("outcome")), ["owner"], ["ts", "event_id"]).select("owner", "outcome", F.col("ts").alias("seen"))
    w = Window.partitionBy("owner").orderBy(F.col("due").asc_nulls_first(), "card")
    return due(cards(s, d)).join(last, "owner", "left").select("card", "owner", "outcome", "seen", F.row_number().over(w).cast("long").alias("place"))


_DAYS = "CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 10 WHEN 'login' THEN 3 ELSE 5 END"


@q(f"""
SELECT user_id, count(*) AS reps, count(*) FILTER (WHERE event_type = 'error') AS lapses, max(ts) AS last,
  max(ts) + CASE WHEN arg_max({_DAYS}, (ts, event_id)) = 0 THEN INTERVAL 20 MINUTE ELSE to_days(arg_max({_DAYS}, (ts, event_id))) END AS next_due
FROM events GROUP BY 1
""")
def P5_record_reviews(s, d):
    e = t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("reps"), F.count_if(F.col("event_type") == "error").alias("lapses"), F.max("ts").alias("last"), F.max_by(F.expr(_DAYS), F.struct("ts", "event_id")).alias("n"))
    return e.select("user_id", "reps", "lapses", "last", F.when(F.col("n") == 0, F.col("last") + F.expr("INTERVAL 20 MINUTES")).otherwise(F.col("last") + F.make_dt_interval("n")).alias("next_due"))


# Deltas by outcome for recall and transfer; the fold clamps at 0 and 1 after every review.
_RECALL = "CASE event_type WHEN 'error' THEN -0.12 WHEN 'purchase' THEN 0.08 WHEN 'click' THEN 0.02 WHEN 'login' THEN 0.01 ELSE 0.0 END"
_TRANSFER = "CASE event_type WHEN 'error' THEN -0.04 WHEN 'purchase' THEN 0.1 WHEN 'view' THEN 0.03 ELSE 0.0 END"
_FOLD = "round(list_reduce(list_prepend(0.5::DOUBLE, list(CAST({} AS DOUBLE) ORDER BY ts, event_id)), lambda a, b: greatest(0.0, least(1.0, a + b))), 3)"


def mastery(events):
    """Recall and transfer of each user after all reviews, and the state they make.

    A clamped sum is a composition of functions x -> min(hi, max(lo, x + c)), but its value depends on the order; a user's
    reviews are folded in one array of two small numbers each.
    """
    one = F.struct("ts", "event_id", F.expr(f"CAST({_RECALL} AS DOUBLE)").alias("r"), F.expr(f"CAST({_TRANSFER} AS DOUBLE)").alias("t"))
    g = events.groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("e"))
    fold = lambda f: F.round(F.aggregate("e", F.lit(0.5), lambda a, x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), a + x[f]))), 3)
    m = g.select("user_id", fold("r").alias("recall"), fold("t").alias("transfer"))
    return m.withColumn("mastery", F.round(F.col("recall") * 0.6 + F.col("transfer") * 0.4, 2))


_MASTERY = f"(SELECT user_id, {_FOLD.format(_RECALL)} AS recall, {_FOLD.format(_TRANSFER)} AS transfer FROM events GROUP BY 1)"


@q(f"SELECT user_id, recall, transfer, round(recall * 0.6 + transfer * 0.4, 2) AS mastery FROM {_MASTERY}")
def P6_mastery_update(s, d):
    return mastery(t(s, d, "events"))


@q(f"""
SELECT user_id, mastery, CASE WHEN mastery < 0.45 THEN 'weak' WHEN mastery < 0.75 THEN 'fair' ELSE 'strong' END AS band, coalesce(n, 0) AS due_cards
FROM (SELECT user_id, round(recall * 0.6 + transfer * 0.4, 2) AS mastery FROM {_MASTERY}) LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE {_CARD_DUE} IS NULL OR {_CARD_DUE} <= TIMESTAMP '{TODAY}' GROUP BY 1) ON o_custkey = user_id
ORDER BY mastery, user_id LIMIT 8
""")
def P7_mastery_snapshot(s, d):
    m = F.col("mastery")
    n = due(cards(s, d)).groupBy(F.col("owner").alias("user_id")).agg(F.count("*").alias("n"))
    weakest = mastery(t(s, d, "events")).orderBy("mastery", "user_id").limit(8)
    return weakest.join(n, "user_id", "left").select("user_id", "mastery", F.when(m < 0.45, "weak").when(m < 0.75, "fair").otherwise("strong").alias("band"), F.coalesce("n", F.lit(0)).cast("long").alias("due_cards"))


@q(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), e AS (SELECT * FROM r WHERE k <= 24),
w AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e),
c AS (SELECT user_id, count(*) FILTER (WHERE value < 10) AS lowconf, count(*) FILTER (WHERE event_type = 'error') AS confusion, count(*) FILTER (WHERE event_type <> before) AS switches FROM w GROUP BY 1),
n AS (SELECT o_custkey, count(*) AS due FROM orders WHERE {_CARD_DUE} IS NULL OR {_CARD_DUE} <= TIMESTAMP '{TODAY}' GROUP BY 1)
SELECT user_id, lowconf, confusion, switches, coalesce(due, 0) AS due, round((1 - (recall * 0.6 + transfer * 0.4)) * 60 + 15 * lowconf + 12 * confusion + 8 * coalesce(due, 0), 3) AS score,
  CASE WHEN switches >= 20 THEN 'focus' WHEN confusion + lowconf >= 10 THEN 'clarify' WHEN coalesce(due, 0) >= 4 THEN 'review' ELSE 'continue' END AS action
FROM c JOIN {_MASTERY} USING (user_id) LEFT JOIN n ON o_custkey = user_id
""")
def P8_momentum(s, d):
    ev = t(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = ev.withColumn("k", F.row_number().over(w)).where("k <= 24").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    c = e.groupBy("user_id").agg(F.count_if(F.col("value") < 10).alias("lowconf"), F.count_if(F.col("event_type") == "error").alias("confusion"), F.count_if(F.col("event_type") != F.col("before")).alias("switches"))
    n = due(cards(s, d)).groupBy(F.col("owner").alias("user_id")).agg(F.count("*").alias("due"))
    j = c.join(mastery(ev).drop("mastery"), "user_id").join(n, "user_id", "left").withColumn("due", F.coalesce("due", F.lit(0).cast("long")))
    score = (1 - (F.col("recall") * 0.6 + F.col("transfer") * 0.4)) * 60 + 15 * F.col("lowconf") + 12 * F.col("confusion") + 8 * F.col("due")
    action = F.when(F.col("switches") >= 20, "focus").when(F.col("confusion") + F.col("lowconf") >= 10, "clarify").when(F.col("due") >= 4, "review").otherwise("continue")
    return j.select("user_id", "lowconf", "confusion", "switches", "due", F.round(score, 3).alias("score"), action.alias("action"))


@q("""
WITH n AS (SELECT n_nationkey AS id, n_name AS label, row_number() OVER (ORDER BY n_nationkey) - 1 AS k, count(*) OVER () AS m FROM nation WHERE n_regionkey IN (1, 3)),
e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT id, label, round(cos(2 * pi() * k / m), 6) AS x, round(sin(2 * pi() * k / m), 6) AS y, (SELECT count(*) FROM e WHERE a = id AND b IN (SELECT id FROM n) AND a <> b) AS links FROM n
""")
def P9_concept_graph(s, d):
    nodes = t(s, d, "nation").where(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    li = t(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(t(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("source")), "l_suppkey")
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("target")), "o_custkey")
    edges = R.induced_edges(li.join(o, "l_orderkey").select("source", "target").distinct(), nodes, "id").where("source <> target")
    links = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("links"))
    w = Window.orderBy("id")  # the nodes of one picture
    angle = 2 * F.pi() * (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy(F.lit(1)))
    return nodes.select("id", "label", F.round(F.cos(angle), 6).alias("x"), F.round(F.sin(angle), 6).alias("y")).join(links, "id", "left").na.fill(0, ["links"])


@q("""
WITH h AS (SELECT *, count(*) OVER (PARTITION BY md5(text)) > 1 AS copy FROM documents)
SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, count(*) FILTER (WHERE copy) AS copies, count(quality) AS labelled, count(*) FILTER (WHERE quality = 0) AS rejected, round(avg(n_chars), 3) AS mean_chars FROM h LEFT JOIN labels USING (doc_id) GROUP BY 1
""")
def P10_library_dashboard(s, d):
    docs = t(s, d, "documents").select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("h"))
    copies = docs.groupBy("h").agg(F.count("*").alias("n"))
    j = docs.join(copies, "h").join(t(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy("source").agg(
        F.count("*").alias("docs"), F.countDistinct("lang").alias("langs"), F.count_if(F.col("n") > 1).alias("copies"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 0).alias("rejected"),
        F.round(F.avg("n_chars"), 3).alias("mean_chars"),
    )


@q("""
WITH r AS (SELECT user_id, count(*) AS reps, count(*) FILTER (WHERE event_type = 'error') * 2 AS lapses FROM events GROUP BY 1)
SELECT count(*) AS cards, sum(reps)::BIGINT AS reviews, round(100.0 * sum(greatest(reps - lapses, 0)) / sum(greatest(reps, 1)), 2) AS retention FROM r
""")
def P11_stats_retention(s, d):
    r = t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("reps"), (F.count_if(F.col("event_type") == "error") * 2).alias("lapses"))
    kept = F.sum(F.greatest(F.col("reps") - F.col("lapses"), F.lit(0))) * 100.0 / F.sum(F.greatest("reps", F.lit(1)))
    return r.agg(F.count("*").alias("cards"), F.sum("reps").alias("reviews"), F.round(kept, 2).alias("retention"))


@q("SELECT event_id, ts, event_type, coalesce(c_name, 'unknown') AS name FROM events LEFT JOIN customer ON c_custkey = user_id ORDER BY ts DESC, event_id DESC LIMIT 50")
def P12_recent_events_with_names(s, d):
    recent = t(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    j = recent.join(t(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left")
    return j.select("event_id", "ts", "event_type", F.coalesce("c_name", F.lit("unknown")).alias("name"))


@q("""
SELECT o_orderkey, count(l_linenumber) AS evidence, count(DISTINCT s_name) AS sources, min(p_name) AS first_part, coalesce(round(sum(l_quantity), 2), 0) AS quantity
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1
""")
def P13_provenance(s, d):
    li = t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    li = li.join(t(s, d, "part").select("p_partkey", "p_name"), "p_partkey", "left").join(t(s, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left")
    return t(s, d, "orders").select("o_orderkey").join(li, "o_orderkey", "left").groupBy("o_orderkey").agg(
        F.count("l_linenumber").alias("evidence"), F.countDistinct("s_name").alias("sources"), F.min("p_name").alias("first_part"), F.coalesce(F.round(F.sum("l_quantity"), 2), F.lit(0.0)).alias("quantity")
    )


@q("""
WITH now AS (SELECT l_orderkey AS k, md5(CAST(CAST(round(sum(l_extendedprice)) AS BIGINT) AS VARCHAR)) AS h FROM lineitem GROUP BY 1), seen AS (SELECT o_orderkey AS k, o_custkey, md5(CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR)) AS h FROM orders)
SELECT o_custkey, count(*) AS snapshots, count(*) FILTER (WHERE now.h IS NULL) AS gone, count(*) FILTER (WHERE now.h <> seen.h) AS stale FROM seen LEFT JOIN now USING (k) GROUP BY 1
""")
def P14_stale_tracking(s, d):
    # what was recorded with the order against what its lines come to now
    digest = lambda c: F.md5(F.round(c).cast("long").cast("string"))
    now = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(digest(F.sum("l_extendedprice")).alias("now"))
    seen = t(s, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", digest(F.col("o_totalprice")).alias("h"))
    return seen.join(now, "k", "left").groupBy("o_custkey").agg(F.count("*").alias("snapshots"), F.count_if(F.col("now").isNull()).alias("gone"), F.count_if(F.col("now") != F.col("h")).alias("stale"))


_TOK = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z]{{3,}}'), lambda x: lower(x)))"


@q(f"""
WITH x AS (SELECT conv_id, turn, {_TOK.format('text')} AS b, lag({_TOK.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations)
SELECT conv_id, turn, list_sort(list_filter(a, lambda x: list_contains(b, x)))[1:4] AS shared, list_sort(list_filter(a, lambda x: NOT list_contains(b, x)))[1:4] AS only_before, list_sort(list_filter(b, lambda x: NOT list_contains(a, x)))[1:4] AS only_now
FROM x WHERE a IS NOT NULL
""")
def P15_concept_compare(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t(s, d, "conversations").select("conv_id", "turn", F.array_distinct(X.tokens("text")).alias("b")).withColumn("a", F.lag("b").over(w)).where("a IS NOT NULL")
    first = lambda c: F.slice(F.array_sort(c), 1, 4)
    return x.select("conv_id", "turn", first(F.array_intersect("a", "b")).alias("shared"), first(F.array_except("a", "b")).alias("only_before"), first(F.array_except("b", "a")).alias("only_now"))


@q("""
SELECT o_orderkey AS note, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, n_name, 'General') AS subject, coalesce(c_name, 'Inbox') AS folder
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def P16_notes_with_fallback(s, d):
    c = t(s, d, "customer").join(t(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left").withColumnRenamed("c_custkey", "o_custkey")
    j = t(s, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left")
    return j.select(F.col("o_orderkey").alias("note"), F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), "n_name", F.lit("General")).alias("subject"), F.coalesce("c_name", F.lit("Inbox")).alias("folder"))


@q("""
WITH u AS (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1), i AS (SELECT *, round(p_size * 0.5 + coalesce(uses, 0) * 2 + CASE WHEN p_retailprice > 1500 THEN 3 ELSE 0 END, 3) AS importance FROM part LEFT JOIN u ON l_partkey = p_partkey),
b AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY importance DESC, p_partkey) AS r FROM i)
SELECT p_brand, p_type, p_partkey, importance, row_number() OVER (PARTITION BY p_brand ORDER BY importance DESC, p_partkey) AS place FROM b WHERE r = 1
""")
def P17_artifact_items(s, d):
    u = t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"))
    i = t(s, d, "part").join(u, "p_partkey", "left")
    i = i.withColumn("importance", F.round(F.col("p_size") * 0.5 + F.coalesce("uses", F.lit(0)) * 2 + F.when(F.col("p_retailprice") > 1500, 3).otherwise(0), 3))
    best = R.topk_per_key(i, ["p_type"], [F.desc("importance"), F.col("p_partkey")], 1)  # one item a description
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("importance"), "p_partkey")).cast("long")
    return best.select("p_brand", "p_type", "p_partkey", "importance", place.alias("place"))


@q("""
SELECT p_partkey, round(len(regexp_extract_all(lower(p_name), '[a-z]+')) * 1.5 + CASE WHEN p_size > 25 THEN 2 ELSE 0 END - abs(length(p_name) - 18) * 0.1, 3) AS score FROM part
""")
def P18_selector_score(s, d):
    words = F.size(X.matches(F.lower("p_name"), "[a-z]+"))
    return t(s, d, "part").select("p_partkey", F.round(words * 1.5 + F.when(F.col("p_size") > 25, 2).otherwise(0) - F.abs(F.length("p_name") - 18) * 0.1, 3).alias("score"))


STATES = ("weak", "saved", "carded", "mastered", "archived")
#: From each state the states that may follow; any may be archived, archived is the end.
NEXT = {"weak": ("saved", "archived"), "saved": ("carded", "archived"), "carded": ("mastered", "archived"), "mastered": ("archived",), "archived": ()}
_ASKED = "CASE event_type WHEN 'login' THEN 'saved' WHEN 'click' THEN 'carded' WHEN 'purchase' THEN 'mastered' WHEN 'error' THEN 'archived' ELSE 'weak' END"
_ALLOWED = " OR ".join(f"({{a}} = '{a}' AND {{b}} = '{b}')" for a, n in NEXT.items() for b in n)


@q(f"""
WITH x AS (SELECT user_id, list({_ASKED} ORDER BY ts, event_id) AS asked FROM events WHERE NOT (event_type = 'error' AND value < 40) GROUP BY 1),
f AS (SELECT list_reduce(list_prepend('weak', asked), lambda a, b: CASE WHEN {_ALLOWED.format(a='a', b='b')} THEN b ELSE a END) AS state FROM x)
SELECT s.state, count(f.state) AS n FROM (SELECT unnest({list(STATES)}) AS state) s LEFT JOIN f USING (state) GROUP BY 1
""")
def P19_anchor_states(s, d):
    # the state each user's transitions lead to, refused ones left out; all five states are listed
    asked = F.struct("ts", "event_id", F.expr(_ASKED).alias("s"))
    g = t(s, d, "events").where("NOT (event_type = 'error' AND value < 40)").groupBy("user_id").agg(F.sort_array(F.collect_list(asked)).alias("e"))
    allowed = F.create_map(*[x for a, n in NEXT.items() for x in (F.lit(a), F.array(*map(F.lit, n)) if n else F.array().cast("array<string>"))])
    end = F.aggregate("e", F.lit("weak"), lambda a, x: F.when(F.array_contains(F.element_at(allowed, a), x["s"]), x["s"]).otherwise(a))
    n = g.groupBy(end.alias("state")).agg(F.count("*").alias("n"))
    return s.createDataFrame([(x,) for x in STATES], "state string").join(n, "state", "left").na.fill(0, ["n"])


MARKERS = {"confused": ("confus", "don't understand", "lost"), "mixes_up": ("mix", "same as", "versus"), "asks_why": ("why", "how come")}


@q("""
SELECT conv_id, count(*) FILTER (WHERE regexp_matches(lower(text), 'confus|don''t understand|lost')) AS confused, count(*) FILTER (WHERE regexp_matches(lower(text), 'mix|same as|versus')) AS mixes_up,
  count(*) FILTER (WHERE regexp_matches(lower(text), 'why|how come')) AS asks_why, count(DISTINCT lower(text)) AS distinct_turns FROM conversations WHERE role = 'user' GROUP BY 1
""")
def P20_misconception_flags(s, d):
    c = t(s, d, "conversations").where("role = 'user'")
    return c.groupBy("conv_id").agg(*[F.count_if(F.lower("text").rlike("|".join(v))).alias(k) for k, v in MARKERS.items()], F.countDistinct(F.lower("text")).alias("distinct_turns"))


@q("""
WITH x AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM conversations),
o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM x WHERE role = 'user' AND (after IS NULL OR after <> 'assistant'))
SELECT c.conv_id, count(*) AS turns, coalesce(max(n), 0) AS open_questions FROM conversations c LEFT JOIN (SELECT conv_id, count(*) FILTER (WHERE r <= 4) AS n FROM o GROUP BY 1) USING (conv_id) GROUP BY 1
""")
def P21_session_completion(s, d):
    c = t(s, d, "conversations")
    x = c.withColumn("after", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).where("role = 'user' AND (after IS NULL OR after <> 'assistant')")
    n = x.groupBy("conv_id").agg(F.least(F.count("*"), F.lit(4)).alias("open_questions"))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns")).join(n, "conv_id", "left").na.fill(0, ["open_questions"])


@q("""
WITH old AS (SELECT o_orderkey AS fingerprint, o_orderpriority AS body, o_orderstatus = 'F' AS sealed FROM orders WHERE o_custkey % 2 = 0),
new AS (SELECT o_orderkey AS fingerprint, o_orderpriority || '*' AS body, o_totalprice > 100000 AS sealed FROM orders WHERE o_custkey % 3 = 0)
SELECT coalesce(o.fingerprint, n.fingerprint) AS fingerprint, CASE WHEN o.sealed OR n.fingerprint IS NULL THEN o.body ELSE n.body END AS body, coalesce(o.sealed, false) OR coalesce(n.sealed, false) AS sealed,
  CASE WHEN n.fingerprint IS NULL THEN 'kept' WHEN o.fingerprint IS NULL THEN 'inserted' WHEN o.sealed AND n.sealed THEN 'unchanged' WHEN o.sealed THEN 'refused' ELSE 'updated' END AS outcome
FROM old o FULL JOIN new n ON o.fingerprint = n.fingerprint
""")
def P22_briefs_seal(s, d):
    # two sets of briefs that overlap: sealed ones stay as they are
    o = t(s, d, "orders").withColumnRenamed("o_orderkey", "fingerprint")
    old = o.where("o_custkey % 2 = 0").select("fingerprint", F.col("o_orderpriority").alias("body"), (F.col("o_orderstatus") == "F").alias("sealed"))
    new = o.where("o_custkey % 3 = 0").select("fingerprint", F.concat("o_orderpriority", F.lit("*")).alias("body"), (F.col("o_totalprice") > 100000).alias("sealed"))
    return R.upsert_unsealed(old, new, "fingerprint", "body", "sealed")


@q("""
SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2
""")
def P23_usage_events(s, d):
    kept = F.from_json("props", "map<string,string>")
    e = t(s, d, "events").where(F.element_at(kept, "k").isNotNull())
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@q(r"""
WITH x AS (SELECT item_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda w: length(w) >= 24)[1:3] AS l FROM benchmark)
SELECT item_id, unnest(l) AS answer, generate_subscripts(l, 1) AS place FROM x
""")
def P24_note_to_cards(s, d):
    flat = F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))
    parts = F.filter(F.split(F.regexp_replace(flat, r"([.!?]) ", "$1\n"), "\n"), lambda w: F.length(w) >= 24)
    return t(s, d, "benchmark").select("item_id", F.posexplode(F.slice(parts, 1, 3)).alias("p", "answer")).select("item_id", "answer", (F.col("p") + 1).cast("long").alias("place"))


@q("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'verified' WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'unsupported' WHEN l_quantity < 5 THEN 'unknown'
  WHEN l_returnflag = 'N' AND l_discount > 0.05 THEN 'verified' WHEN l_returnflag = 'N' THEN 'unknown' ELSE 'unsupported' END AS card FROM lineitem
""")
def P25_verdict_mapping(s, d):
    # first match wins: citations, absent section, unverified quote, clause verdict, else unsupported
    li, flag = t(s, d, "lineitem"), F.col("l_returnflag")
    verdict = (
        F.when((flag == "A") & (F.col("l_linenumber") % 2 == 0), "verified").when((F.col("l_linestatus") == "F") & (flag == "R"), "unsupported").when(F.col("l_quantity") < 5, "unknown")
        .when((flag == "N") & (F.col("l_discount") > 0.05), "verified").when(flag == "N", "unknown").otherwise("unsupported")
    )
    return li.select("l_orderkey", "l_linenumber", verdict.alias("card"))


@q("""
WITH c AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 100) AS BIGINT) AS b FROM events),
p AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600 THEN 0 ELSE 1 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS piece FROM p)
SELECT user_id, CAST(piece AS BIGINT) AS piece, count(*) AS n, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2
""")
def P26_adjacent_citations(s, d):
    a = F.unix_seconds(F.col("ts").cast("timestamp"))
    c = t(s, d, "events").select("user_id", "event_id", a.alias("a"), (a + F.floor(F.col("value") * 100).cast("long")).alias("b"))
    return R.joined_spans(c, ["user_id"], "a", "b", "event_id", 600)
