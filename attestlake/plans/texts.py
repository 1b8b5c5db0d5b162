"""Text, number, date, hash and JSON functions over documents, conversations, events and generated sentences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestlake.functions import text as X
from attestlake.operators import attest
from attestlake.operators.lineage import spread
from attestlake.plans import attestation
from attestlake.plans.base import Book, t

q = Book()
QUERIES, ORACLE = q.queries, q.oracle
WS = r"'\s+'"


@q("SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS folded FROM documents")
def X1_fold(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.fold("text")).alias("folded"))


@q("SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS canonical FROM documents")
def X2_canonical(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.canonical("text")).alias("canonical"))


@q("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda x: lower(x)), ' ') AS tokens FROM documents")
def X3_tokens(s, d):
    return t(s, d, "documents").select("doc_id", F.array_join(X.tokens("text"), " ").alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in X.TOPIC_STOP_WORDS)


@q(f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w)))), ' ') AS tokens FROM documents
""")
def X4_fact_tokens(s, d):
    return spread(t(s, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(F.array_sort(X.fact_tokens("text")), " ").alias("tokens"))


@q("""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda w: regexp_replace(w, 's$', '')), lambda w: w NOT IN ('that', 'this', 'with')))), ' ') AS tokens FROM documents
""")
def X5_topic_tokens(s, d):
    return t(s, d, "documents").select("doc_id", F.array_join(F.array_sort(X.topic_tokens("text", ["that", "this", "with"])), " ").alias("tokens"))


@q("""
SELECT item_id, list_filter(list_transform(regexp_split_to_array(trim(text), '[ \\t\\n]+'), lambda w: regexp_replace(regexp_replace(w, '^[^\\pL\\pN_]+', ''), '[^\\pL\\pN_]+$', '')), lambda w: w <> '') AS tokens FROM benchmark
""")
def X6_edge_tokens(s, d):
    return t(s, d, "benchmark").select("item_id", X.edge_tokens("text").alias("tokens"))


@q("""
SELECT item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n]+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda w: trim(regexp_replace(w, '[ \\t\\n]+', ' ', 'g'))), lambda w: w <> '') AS sentences FROM benchmark
""")
def X7_sentences(s, d):
    return t(s, d, "benchmark").select("item_id", X.simple_sentences("text").alias("sentences"))


@q(r"""
WITH a AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS run FROM benchmark),
b AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS body FROM documents)
SELECT DISTINCT item_id, doc_id, doc_id IS NOT NULL AS present FROM a LEFT JOIN b ON contains(body, run)
""")
def X14_verbatim_anywhere(s, d):
    # each item in every document that holds it; X14_verbatim_presence looks at one document per item
    return present_in(t(s, d, "benchmark"), t(s, d, "documents"))


def present_in(items, docs):
    """item_id and doc_id of each document that holds the item's text; no doc_id for items found nowhere."""
    runs = items.select("item_id", X.fold("text").alias("run"))
    held = attest.containment(runs, docs.select("doc_id", X.fold("text").alias("body")), "run", "body").distinct()
    found = runs.join(held, "run", "left").select("item_id", "doc_id").distinct()
    return found.withColumn("present", F.col("doc_id").isNotNull())


@q("""SELECT page_id, list_transform(regexp_extract_all(html, '"[^"\n]+"'), lambda x: substr(x, 2, length(x) - 2)) AS quoted FROM pages""")
def X16_quoted_spans(s, d):
    return t(s, d, "pages").select("page_id", X.quoted_spans("html").alias("quoted"))


@q("""
SELECT o_orderkey, ['Order ' || o_orderkey || ' was', 'before ' || o_orderpriority] AS phrases FROM orders
""")
def X17_quote_phrases(s, d):
    o = t(s, d, "orders")
    quote = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" was [sic] ... before "), F.col("o_orderpriority"), F.lit(",  ..."))
    return o.select("o_orderkey", X.quote_phrases(quote).alias("phrases"))


@q("SELECT p_partkey, list_distinct([p_name, upper(p_name[1]) || p_name[2:], lower(p_name[1]) || p_name[2:]]).list_sort() AS variants FROM part")
def X18_case_variants(s, d):
    return t(s, d, "part").select("p_partkey", F.array_sort(X.first_letter_variants("p_name")).alias("variants"))


@q("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[$€£]?[0-9][0-9,]*(?:\\.[0-9]+)?%?', '#', 'g'), '[^a-z#]+', ' ', 'g'))) AS skeleton FROM documents")
def X19_skeleton(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.figure_skeleton("text")).alias("skeleton"))


@q("SELECT p_partkey, 'part Type ' || p_partkey || ' x' AS label FROM part")
def X21_clean_label(s, d):
    return t(s, d, "part").select("p_partkey", X.clean_label(F.concat(F.lit("partPart_Type--type"), F.col("p_partkey").cast("string"), F.lit("x"))).alias("label"))


@q("SELECT doc_id, substr(text, 1, 240) AS snippet FROM documents")
def X22_snippet(s, d):
    return t(s, d, "documents").select("doc_id", F.substring("text", 1, 240).alias("snippet"))


@q("""
SELECT item_id, array_to_string(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: '"' || x || '"'), ' OR ') AS query FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS w FROM benchmark)
""")
def X23_or_query(s, d):
    return t(s, d, "benchmark").select("item_id", X.or_query("text").alias("query"))


@q("SELECT c_custkey, 'the ' || c_name || ' of ' || c_mktsegment AS plain, contains(lower('the ' || c_name || ' of ' || c_mktsegment), 'build') AS hit FROM customer")
def X25_strip_cloze(s, d):
    raw = F.concat(F.lit("the {{c1::"), F.col("c_name"), F.lit("}} of {{c2::"), F.col("c_mktsegment"), F.lit("::hint}}"))
    plain = X.strip_cloze(raw)
    return t(s, d, "customer").select("c_custkey", plain.alias("plain"), F.contains(F.lower(plain), F.lit("build")).alias("hit"))


F4 = "SELECT doc_id FROM documents WHERE lower(text) LIKE '%then_he%'"


@q(F4)
def F4_substring_search(s, d):
    return t(s, d, "documents").where(F.lower(X.strip_cloze("text")).like("%then_he%")).select("doc_id")


@q("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def X27_escape_markup(s, d):
    return t(s, d, "pages").select("page_id", X.escape_markup("html").alias("escaped"))


@q("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(regexp_extract(substr(text, 1, 80), '(?s)^(.*)\\s', 1)) END AS cut FROM documents")
def X28_cut_at_word(s, d):
    return t(s, d, "documents").select("doc_id", X.cut_at_word("text", 80).alias("cut"))


SENTENCE = "'Order ' || o_orderkey || ' totals $' || CAST(floor(o_totalprice) AS BIGINT) || CASE WHEN o_orderkey % 3 = 0 THEN ' thousand' ELSE '' END || ' at ' || (o_orderkey % 90) || '.5% on ' || strftime(o_orderdate, '%Y-%m-%d') || '.'"


def _sentences(s, d):
    o = t(s, d, "orders")
    text = F.concat(
        F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" totals $"), F.floor("o_totalprice").cast("long").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, " thousand").otherwise(""),
        F.lit(" at "), (F.col("o_orderkey") % 90).cast("string"), F.lit(".5% on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("."),
    )
    return o.select("o_orderkey", "o_totalprice", "o_orderdate", text.alias("text"))


@q(f"""
SELECT o_orderkey, {SENTENCE} AS text, CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE 1 END * 100 AS cents, CAST((o_orderkey % 90) * 100 + 50 AS DOUBLE) AS bps, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders
""")
def N1_N5_D1_money_percent_date(s, d):
    return _sentences(s, d).select(
        "o_orderkey", "text", X.money_cents("text").alias("cents"), X.percent_bps("text").cast("double").alias("bps"),
        X.unambiguous_date(F.regexp_extract("text", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)).alias("iso"),
    )


@q("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey * 1000 + 7 AS DOUBLE) END AS n FROM supplier")
def N3_grouped_number(s, d):
    k = F.col("s_suppkey")
    raw = F.when(k % 2 == 0, F.format_number(k * 1000 + 7, 0)).otherwise(F.concat(k.cast("string"), F.lit(",7")))
    return t(s, d, "supplier").select("s_suppkey", X.grouped_number(raw).cast("double").alias("n"))


@q("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.5' ELSE NULL END AS key FROM part")
def N6_numeric_key(s, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".00"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".50"))).otherwise("none")
    return t(s, d, "part").select("p_partkey", X.numeric_key(raw).alias("key"))


@q("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey BETWEEN 1000 AND 999999999 AND l_orderkey NOT BETWEEN 1800 AND 2199 THEN [l_orderkey] ELSE []::BIGINT[] END AS counts FROM lineitem")
def N12_count_anchors(s, d):
    li = t(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.count_anchors(F.concat(F.lit("It lists "), F.col("l_orderkey").cast("string"), F.lit(" rows, 99.5 of them."))).alias("counts"))


@q("SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS s, round(greatest(0, least(1, value / 50)), 9) AS c FROM events")
def N13_sigmoid_clamp(s, d):
    return t(s, d, "events").select("event_id", F.round(X.sigmoid(F.col("value") / 100), 9).alias("s"), F.round(X.clamp(F.col("value") / 50), 9).alias("c"))


@q("""
WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation)
SELECT n_nationkey, round(0.5 + 0.4 * cos(2 * pi() * i / n), 6) AS x, round(0.5 + 0.4 * sin(2 * pi() * i / n), 6) AS y FROM r
""")
def N14_circular_layout(s, d):
    n = t(s, d, "nation").select("n_nationkey")
    r = n.withColumn("i", F.row_number().over(Window.orderBy("n_nationkey")) - 1).crossJoin(F.broadcast(n.agg(F.count("*").alias("n"))))
    a = 2 * F.pi() * F.col("i") / F.col("n")
    return r.select("n_nationkey", F.round(0.5 + 0.4 * F.cos(a), 6).alias("x"), F.round(0.5 + 0.4 * F.sin(a), 6).alias("y"))


@q("""
SELECT o_orderkey, CASE WHEN month(o_orderdate) <> day(o_orderdate) AND day(o_orderdate) <= 12 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso, strftime(o_orderdate, '%Y-%m-%d') AS named FROM orders
""")
def D1_ambiguous_dates_refuse(s, d):
    o = t(s, d, "orders")
    return o.select("o_orderkey", X.unambiguous_date(F.date_format("o_orderdate", "d/M/yyyy")).alias("iso"), X.unambiguous_date(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("named"))


@q("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 37 AS INTEGER)) AS DATE) AS due FROM orders")
def D3_add_months(s, d):
    return t(s, d, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), (F.col("o_orderkey") % 37).cast("int")).alias("due"))


@q("SELECT l_orderkey, l_linenumber, CAST(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def D2_day_span(s, d):
    j = t(s, d, "lineitem").join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return j.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@q("""
WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, DATE '2001-03-15' AS b FROM orders), g AS (SELECT *, (year(b) - year(a)) * 12 + month(b) - month(a) AS m FROM x)
SELECT o_orderkey, CAST(CASE WHEN a + to_months(CAST(m AS INTEGER)) > b THEN m - 1 ELSE m END AS BIGINT) AS months FROM g
""")
def D4_whole_months(s, d):
    return t(s, d, "orders").select("o_orderkey", X.whole_months(F.to_date("o_orderdate"), F.lit("2001-03-15").cast("date")).cast("long").alias("months"))


@q("""
SELECT event_id, CASE WHEN n = 0 THEN ts + INTERVAL 20 MINUTE ELSE ts + to_days(n) END AS due FROM (
  SELECT *, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN CASE WHEN value < 20 THEN 0 ELSE 1 END WHEN 'purchase' THEN 10 WHEN 'login' THEN 3 ELSE 5 END AS n FROM events)
""")
def D5_next_due(s, d):
    kind = F.col("event_type")
    n = F.when(kind == "error", 0).when(kind == "click", F.when(F.col("value") < 20, 0).otherwise(1)).when(kind == "purchase", 10).when(kind == "login", 3).otherwise(5)
    due = F.when(n == 0, F.col("ts") + F.expr("INTERVAL 20 MINUTES")).otherwise(F.col("ts") + F.make_dt_interval(n))
    return t(s, d, "events").select("event_id", due.alias("due"))


@q("SELECT doc_id, sha256(text) AS h, substr(sha256(text), 1, 32) AS short FROM documents")
def H1_content_hash(s, d):
    return t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.substring(F.sha2("text", 256), 1, 32).alias("short"))


@q("""
SELECT event_id, CASE WHEN json_valid(p) THEN json_extract_string(p, '$.k') END AS k, json_valid(p) AS valid FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'broken{' ELSE props END AS p FROM events)
""")
def S5_json_with_fallback(s, d):
    p = F.when(F.col("event_id") % 11 == 0, "broken{").otherwise(F.col("props"))
    v = F.try_parse_json(p)
    return t(s, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), v.isNotNull().alias("valid"))


#: Fragments of property names that are never recorded.
DENIED = ("answer", "api_key", "content", "document_text", "email", "filename", "file_name", "name", "path", "question", "query", "quote", "secret", "selected", "snippet", "text", "token", "user")


def privacy_filter(props):
    """properties with plain names, no denied fragment, strings up to 120 or finite numbers, values as strings; over 4000 bytes: none."""
    m = F.from_json(props, "map<string,string>")
    fine = F.map_filter(m, lambda k, v: k.rlike("^[a-z][a-z0-9_]{0,63}$") & ~k.rlike("|".join(DENIED)) & v.isNotNull() & (F.length(F.trim(v)) <= 120) & ~F.lower(v).isin("nan", "infinity", "-infinity"))
    out = F.to_json(F.transform_values(fine, lambda k, v: F.trim(v)))
    return F.coalesce(F.when(F.octet_length(out) <= 4000, out), F.lit("{}"))


@q("""
SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN '{}' ELSE '{"count":"' || c_custkey || '","segment":"' || c_mktsegment || '"' || CASE WHEN length(c_name) * (c_custkey % 12) <= 120 THEN ',"note":"' || repeat(c_name, (c_custkey % 12)::INT) || '"' ELSE '' END || '}' END AS kept FROM customer
""")
def F15_privacy_filter(s, d):
    # denied names, names that aren't plain, long values and broken JSON among what every customer sends
    k = F.col("c_custkey")
    note = F.expr("repeat(c_name, CAST(c_custkey % 12 AS INT))")
    props = F.concat(
        F.lit('{"count": '), k.cast("string"), F.lit(', "user_id": 5, "Segment": "x", "segment": " '), "c_mktsegment", F.lit(' ", "selected_part": "y", "snippet": "z", "reply_token": 1, "bad key": 2, "note": "'), note,
        F.lit('", "file_names": "a", "gone": null'), F.when(k % 10 == 9, "").otherwise("}"),
    )
    return t(s, d, "customer").select("c_custkey", privacy_filter(props).alias("kept"))


def typed_properties(props):
    """F15, whole: as privacy_filter, but values keep their types: numbers that are finite, true, false, null, strings of up to 120
    without the space around them. Lists and objects go, broken JSON and what isn't an object give {}. Names come in order."""
    # Several objects of one text or a name that comes twice are no JSON object here: none of it is recorded.
    entries = F.map_entries(F.try_parse_json(F.when(F.trim(props).startswith("{"), props)).cast("map<string,variant>"))
    kind = lambda e: F.schema_of_variant(e["value"])
    said = lambda e: F.trim(F.try_variant_get(e["value"], "$", "string"))
    number = lambda e: F.coalesce(F.try_variant_get(e["value"], "$", "double"), F.lit(0.0))

    def stays(e):
        value = F.when(kind(e) == "STRING", F.length(said(e)) <= 120).when(kind(e).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.abs(number(e)) < float("inf")).otherwise(kind(e).isin("BOOLEAN", "VOID"))
        return e["key"].rlike("^[a-z][a-z0-9_]{0,63}$") & ~e["key"].rlike("|".join(DENIED)) & value

    kept = F.transform(F.filter(entries, stays), lambda e: F.struct(e["key"].alias("key"), F.when(kind(e) == "STRING", said(e).cast("variant")).otherwise(e["value"]).alias("value")))
    out = F.to_json(F.map_from_entries(kept))
    return F.coalesce(F.when(F.octet_length(out) <= 4000, out), F.lit("{}"))


@q("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN '{}' ELSE '{"count":' || o_orderkey || ',"gone":null,"late":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || CASE WHEN o_orderkey % 3 = 0 THEN ',"ratio":0.5' ELSE '' END
  || ',"state":"' || o_orderstatus || '"}' END AS kept FROM orders
""")
def F15_typed_properties(s, d):
    # lists, objects, numbers beyond doubles, names that are denied or not plain, and broken JSON among what every order sends
    k = F.col("o_orderkey")
    props = F.concat(
        F.lit('{"state": " '), "o_orderstatus", F.lit(' ", "count": '), k.cast("string"), F.lit(', "late": '), (k % 2 == 0).cast("string"), F.lit(', "ratio": '), F.when(k % 3 == 0, "0.5").otherwise("1e999"),
        F.lit(', "gone": null, "list": [1], "object": {"a": 1}, "email_sent": true, "Upper": 1, "long": "'), F.repeat("o_orderstatus", F.lit(121)), F.lit('"'), F.when(k % 10 == 9, "").otherwise("}"),
    )
    return t(s, d, "orders").select("o_orderkey", typed_properties(props).alias("kept"))


LINES = "(SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _lines(s, d):
    return t(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@q(f"""
WITH x AS (SELECT doc_id, pos, line, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS v FROM {LINES}),
y AS (SELECT *, length(regexp_replace(v, '[^A-Za-z]', '', 'g')) AS alpha, len(regexp_extract_all(v, '[^ ]+')) AS words FROM x)
SELECT doc_id, pos, regexp_matches(line, '^ *([•–—-]+|[(]?[0-9]+[)]?[.)]|[0-9]+[.][0-9]+) +') AS bullet, alpha < 3 AND length(v) < 24 AS noise,
  regexp_matches(lower(v), '(^|[^a-z])[a-z] *= *') AS formula, words BETWEEN 1 AND 12 AND len(regexp_extract_all(' ' || v, ' [A-Z]')) >= greatest(1, words - 1) AND NOT (regexp_matches(v, '[.!?]') AND words > 8) AS heading FROM y
""")
def F6_content_predicates(s, d):
    x = _lines(s, d).withColumn("v", F.trim(F.regexp_replace("line", "[ \t]+", " ")))
    alpha, words = F.length(F.regexp_replace("v", "[^A-Za-z]", "")), F.size(X.matches("v", "[^ ]+"))
    caps = F.size(X.matches(F.concat(F.lit(" "), F.col("v")), " [A-Z]"))
    return x.select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("line").rlike("^ *([•–—-]+|[(]?[0-9]+[)]?[.)]|[0-9]+[.][0-9]+) +").alias("bullet"), ((alpha < 3) & (F.length("v") < 24)).alias("noise"),
        F.lower("v").rlike("(^|[^a-z])[a-z] *= *").alias("formula"), (words.between(1, 12) & (caps >= F.greatest(F.lit(1), words - 1)) & ~(F.col("v").rlike("[.!?]") & (words > 8))).alias("heading"),
    )


@q(f"""
WITH x AS (SELECT doc_id, pos, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS v FROM {LINES}), y AS (SELECT *, length(regexp_replace(v, '[^A-Za-z]', '', 'g')) AS alpha, len(regexp_extract_all(v, '[^ ]+')) AS words FROM x)
SELECT role, count(*) AS n FROM (SELECT CASE WHEN v = '' THEN 'noise' WHEN regexp_matches(lower(v), 'overview|contents|agenda|learning objectives') THEN 'outline' WHEN regexp_matches(lower(v), 'copyright|all rights reserved') THEN 'footer'
  WHEN alpha < 3 AND length(v) < 24 THEN 'noise' WHEN regexp_matches(lower(v), '(^|[^a-z])[a-z] *= *') THEN 'formula'
  WHEN words <= 12 AND len(regexp_extract_all(' ' || v, ' [A-Z]')) >= greatest(1, words - 1) AND NOT (regexp_matches(v, '[.!?]') AND words > 8) THEN 'heading' ELSE 'body' END AS role FROM y) GROUP BY 1
""")
def F7_span_roles(s, d):
    v = F.col("v")
    x = _lines(s, d).withColumn("v", F.trim(F.regexp_replace("line", "[ \t]+", " ")))
    alpha, words = F.length(F.regexp_replace("v", "[^A-Za-z]", "")), F.size(X.matches("v", "[^ ]+"))
    caps = F.size(X.matches(F.concat(F.lit(" "), v), " [A-Z]"))
    role = (
        F.when(v == "", "noise").when(F.lower(v).rlike("overview|contents|agenda|learning objectives"), "outline").when(F.lower(v).rlike("copyright|all rights reserved"), "footer")
        .when((alpha < 3) & (F.length(v) < 24), "noise").when(F.lower(v).rlike("(^|[^a-z])[a-z] *= *"), "formula")
        .when((words <= 12) & (caps >= F.greatest(F.lit(1), words - 1)) & ~(v.rlike("[.!?]") & (words > 8)), "heading").otherwise("body")
    )
    return x.groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@q(f"""
WITH x AS (SELECT doc_id, pos, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '', 'g'), '[ \\t]+', ' ', 'g')) AS key FROM {LINES}),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS reps FROM x)
SELECT doc_id, count(*) FILTER (WHERE key = '' OR (reps >= 3 AND len(regexp_extract_all(key, '[^ ]+')) <= 12) OR NOT regexp_matches(line, '\\pL') OR (length(regexp_replace(line, '[^\\pL]', '', 'g')) < 3 AND length(line) < 24)
  OR length(regexp_replace(line, '[\\pL\\pN \\t_.,;:!?()/&%+-]', '', 'g'))::DOUBLE / greatest(length(line), 1) > 0.18) AS noise, count(*) AS lines FROM c GROUP BY 1
""")
def F11_noise_lines(s, d):
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), "[0-9]+", ""), "[ \t]+", " "))
    x = _lines(s, d).withColumn("key", key)
    x = x.withColumn("reps", F.count("*").over(Window.partitionBy("doc_id", "key")))
    line = F.col("line")
    noise = (
        (F.col("key") == "") | ((F.col("reps") >= 3) & (F.size(X.matches("key", "[^ ]+")) <= 12)) | ~line.rlike(r"\p{L}")
        | ((F.length(F.regexp_replace(line, r"[^\p{L}]", "")) < 3) & (F.length(line) < 24)) | (F.length(F.regexp_replace(line, r"[\p{L}\p{N} \t_.,;:!?()/&%+-]", "")) / F.greatest(F.length(line), F.lit(1)) > 0.18)
    )
    return x.groupBy("doc_id").agg(F.count_if(noise).alias("noise"), F.count("*").alias("lines"))


@q(f"""
SELECT doc_id, pos, length(line) >= 28 AND length(regexp_replace(line, '[^\\pL]', '', 'g')) >= 20 AND length(line) <= 340 AND NOT contains(line, '?') AS valid FROM {LINES}
""")
def F12_valid_sentence(s, d):
    n = F.length("line")
    return _lines(s, d).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), ((n >= 28) & (F.length(F.regexp_replace("line", r"[^\p{L}]", "")) >= 20) & (n <= 340) & ~F.contains("line", F.lit("?"))).alias("valid"))


@q("""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark),
h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) WHERE w IN (SELECT w FROM v))
SELECT doc_id, coalesce(regexp_matches(text, '[0-9]'), false) OR doc_id IN (SELECT doc_id FROM h) AS relevant FROM documents
""")
def F14_relevance_any_item(s, d):
    # all documents against the tokens of all items; F14_relevance_prefilter meets one item per document
    return relevant_to_any(t(s, d, "documents"), t(s, d, "benchmark"))


def relevant_to_any(docs, items):
    """doc_id and whether the document has a digit or shares a token with any item."""
    w = lambda x: x.select("*", F.explode(F.array_distinct(X.matches(F.lower("text"), "[a-z]{4,}"))).alias("w"))
    digit = F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False))
    shares = w(docs.where(~digit)).join(w(items).select("w").distinct(), "w", "left_semi").select("doc_id").distinct().withColumn("shares", F.lit(True))
    return docs.select("doc_id", digit.alias("digit")).join(shares, "doc_id", "left").select("doc_id", (F.col("digit") | F.coalesce("shares", F.lit(False))).alias("relevant"))


@q("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'R')")
def F16_citation_in_retrieved(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    got = li.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return li.join(got, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@q(rf"""
WITH c AS (SELECT DISTINCT item_id, quote FROM (SELECT item_id, unnest(string_split(regexp_replace({attestation._N}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS quote FROM benchmark) WHERE quote <> ''),
s AS (SELECT conv_id, turn, {attestation._N} AS body FROM conversations)
SELECT DISTINCT item_id, quote, conv_id, turn, conv_id IS NOT NULL AS found FROM c LEFT JOIN s ON contains(body, quote)
""")
def F17_quotes_in_turns(s, d):
    # sentences of another table in turns of any length; F17_exact_quote cuts its quotes from the same text
    return quotes_in(t(s, d, "benchmark"), t(s, d, "conversations"))


def quotes_in(items, turns):
    """each sentence of items with each turn that holds it, case kept; no turn for sentences found nowhere."""
    quotes = attest.claims_of(items, "item_id", "text").select("item_id", F.col("claim").alias("quote")).distinct()
    held = attest.containment(quotes, turns.select("conv_id", "turn", attest.normal("text").alias("body"), F.lit(True).alias("found")), "quote", "body").distinct()
    return quotes.join(held, "quote", "left").select("item_id", "quote", "conv_id", "turn", F.coalesce("found", F.lit(False)).alias("found"))


@q("SELECT l_orderkey, l_linenumber, (l_linenumber < 4 AND 2 < l_linenumber + l_quantity % 3) AS overlaps FROM lineitem")
def J19_span_overlap(s, d):
    claimed = F.array(F.struct(F.lit(2.0).alias("s"), F.lit(4.0).alias("e")))
    a, b = F.col("l_linenumber").cast("double"), F.col("l_linenumber") + F.col("l_quantity") % 3
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.exists(claimed, lambda c: (a < c["e"]) & (c["s"] < b)).alias("overlaps"))
