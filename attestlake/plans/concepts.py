"""Element chunks, heading paths, concept phrases with payloads and depth, decks, captions, attributed quotes, job states."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestlake.operators import concepts as C
from attestlake.operators import folds
from attestlake.plans.base import Book, t
from attestlake.plans.folds import greedy
from attestlake.plans.ingest import _BLOCKS, _MD, _SENTS, _markdown, sentences
from attestlake.sources import documents as S
from attestlake.streaming import events as E

q = Book()
QUERIES, ORACLE = q.queries, q.oracle


@q(f"""
WITH {_BLOCKS.format(_MD)}, e AS (SELECT *, last_value(CASE WHEN kind <> 'body' THEN value END IGNORE NULLS) OVER o AS section, count(*) FILTER (WHERE kind <> 'body') OVER o AS seg FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
g AS (SELECT doc_id, seg, arg_min(section, place) AS section, list({{'open': length(value), 'l': [{{'first': CAST(place AS INT), 'elements': 1, 'size': length(value)}}]}} ORDER BY place) AS l FROM e GROUP BY 1, 2),
c AS (SELECT doc_id, section, list_reduce(l, lambda a, b: CASE WHEN a.open + b.open + 2 > 1200 THEN {{'open': b.open, 'l': list_concat(a.l, b.l)}}
  ELSE {{'open': a.open + b.open + 2, 'l': list_concat(a.l[:-2], [{{'first': a.l[-1].first, 'elements': a.l[-1].elements + 1, 'size': a.open + b.open + 2}}])}} END).l AS l FROM g)
SELECT doc_id, substr(coalesce(section, 'Overview'), 1, 180) AS section, x.first AS first, x.elements AS elements, x.size AS size FROM (SELECT doc_id, section, unnest(l) AS x FROM c)
""")
def I3_element_chunks(s, d):
    return C.element_chunks(S.text_elements(_markdown(s, d), "doc_id", "md"), "doc_id")


@q(f"""
WITH {_BLOCKS.format(_MD)}, p AS (SELECT *, CASE WHEN place % 5 <> 0 THEN CAST(place // 20 + 1 AS INT) END AS page, CASE WHEN place % 3 = 0 THEN 'S' || CAST(place // 50 AS BIGINT) END AS sheet FROM k),
a AS (SELECT *, last_value(page IGNORE NULLS) OVER o AS at_page, last_value(sheet IGNORE NULLS) OVER o AS at_sheet, last_value(CASE WHEN kind <> 'body' THEN value END IGNORE NULLS) OVER o AS section FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, kind <> 'body' OR coalesce(page <> lag(at_page) OVER o, false) OR coalesce(sheet <> lag(at_sheet) OVER o, false) AS opens FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
e AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS seg FROM n),
g AS (SELECT doc_id, seg, arg_min(section, place) AS section, list({{'open': length(value), 'l': [{{'first': CAST(place AS INT), 'elements': 1, 'size': length(value), 'page': at_page, 'sheet': at_sheet}}]}} ORDER BY place) AS l FROM e GROUP BY 1, 2),
c AS (SELECT doc_id, section, list_reduce(l, lambda a, b: CASE WHEN a.open + b.open + 2 > 1200 THEN {{'open': b.open, 'l': list_concat(a.l, b.l)}}
  ELSE {{'open': a.open + b.open + 2, 'l': list_concat(a.l[:-2], [{{'first': a.l[-1].first, 'elements': a.l[-1].elements + 1, 'size': a.open + b.open + 2, 'page': b.l[1].page, 'sheet': b.l[1].sheet}}])}} END).l AS l FROM g)
SELECT doc_id, substr(coalesce(section, 'Overview'), 1, 180) AS section, x.first AS first, x.elements AS elements, x.size AS size, x.page AS page, x.sheet AS sheet FROM (SELECT doc_id, section, unnest(l) AS x FROM c)
""")
def I3_pages_and_sheets(s, d):
    # twenty blocks are a page, fifty a sheet; some blocks know neither
    e = S.text_elements(_markdown(s, d), "doc_id", "md")
    page, sheet = F.when(F.col("place") % 5 != 0, F.floor(F.col("place") / 20).cast("int") + 1), F.when(F.col("place") % 3 == 0, F.concat(F.lit("S"), F.floor(F.col("place") / 50)))
    return C.element_chunks(e.withColumn("page", page).withColumn("sheet", sheet), "doc_id")


# every third line of a document is a heading, one to three deep in turn
_NODES = """
n AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS place, trim(unnest(l)) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
h AS (SELECT *, CASE WHEN place % 3 = 0 THEN place // 3 % 3 + 1 END AS level FROM n WHERE value <> ''),
p AS (SELECT *, last_value(CASE WHEN level = 1 THEN {'p': place, 'v': value} END IGNORE NULLS) OVER o AS a, last_value(CASE WHEN level = 2 THEN {'p': place, 'v': value} END IGNORE NULLS) OVER o AS b, last_value(CASE WHEN level = 3 THEN {'p': place, 'v': value} END IGNORE NULLS) OVER o AS c
  FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
t AS (SELECT doc_id, place, level, value, concat_ws(' > ', a.v, CASE WHEN b.p > coalesce(a.p, -1) THEN b.v END, CASE WHEN c.p > greatest(coalesce(a.p, -1), coalesce(b.p, -1)) THEN c.v END) AS path FROM p)"""


def _nodes(s, d):
    n = t(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "value")).withColumn("value", F.trim("value")).where("value <> ''")
    return n.withColumn("level", F.when(F.col("place") % 3 == 0, F.floor(F.col("place") / 3) % 3 + 1))


@q(f"WITH {_NODES} SELECT doc_id, CAST(place AS INT) AS place, md5(path) AS path FROM t")
def W2_heading_path(s, d):
    return C.heading_path(_nodes(s, d), "doc_id").select("doc_id", "place", F.md5("path").alias("path"))


@q(f"""
WITH {_NODES}, m AS (SELECT *, level IS NULL AND lag(level) OVER o IS NULL AND lag(path) OVER o = path AND NOT regexp_matches(lag(value) OVER o, '[.!?:;]$') AS joins FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
r AS (SELECT *, sum(CASE WHEN coalesce(joins, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) - 1 AS reading_order FROM m),
g AS (SELECT doc_id, reading_order, any_value(path) AS path, CASE WHEN min(level) IS NULL THEN 'body' ELSE 'heading' END AS kind, string_agg(value, ' ' ORDER BY place) AS value FROM r GROUP BY 1, 2),
s AS (SELECT *, sum(length(value) + 2) OVER (PARTITION BY doc_id ORDER BY reading_order ROWS UNBOUNDED PRECEDING) - 2 AS stop FROM g)
SELECT doc_id, reading_order::BIGINT AS reading_order, kind, (stop - length(value))::BIGINT AS start, stop::BIGINT AS stop, md5(path || value) AS content FROM s
""")
def I14_typed_walk(s, d):
    return C.walked(_nodes(s, d), "doc_id").select("doc_id", "reading_order", "kind", "start", "stop", F.md5(F.concat("path", "value")).alias("content"))


_STOP = "['" + "', '".join(C.STOP) + "']"
_ANY = lambda x, marks: "(" + " OR ".join(f"contains(lower({x}), '{m}')" for m in marks) + ")"


def _kept(a: str) -> str:
    return f"array_to_string(list_filter({a}, lambda v: NOT list_contains({_STOP}, v)), ' ')"


_PHRASES = f"""
w AS (SELECT doc_id, pos, s, regexp_extract_all(lower(s), '[a-z]+') AS w, regexp_extract_all(lower(regexp_extract(s, '[A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*)*', 0)), '[a-z]+')[1:3] AS h FROM sent),
c AS (SELECT doc_id, pos, {_kept('h')} AS label, {C.TITLE} AS bonus FROM w UNION ALL SELECT doc_id, pos, {_kept('w[i:i+2]')}, {C.TRIPLE} FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w) UNION ALL SELECT doc_id, pos, {_kept('w[i:i+1]')}, {C.PAIR} FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)),
b AS (SELECT doc_id, pos, label, max(bonus) AS bonus FROM c WHERE length(label) BETWEEN 4 AND 60 GROUP BY 1, 2, 3),
e AS (SELECT doc_id, label, count(*) AS n, sum(bonus) AS bonus, sum(CASE WHEN {_ANY('s', C.DEFINES)} THEN 1 ELSE 0 END) AS defining FROM b JOIN sent USING (doc_id, pos) GROUP BY 1, 2),
f AS (SELECT doc_id, x AS word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM w) WHERE length(x) >= 4 AND NOT list_contains({_STOP}, x) GROUP BY 1, 2),
g AS (SELECT doc_id, label, sum(c) AS c FROM (SELECT doc_id, label, unnest(string_split(label, ' ')) AS word FROM e) JOIN f USING (doc_id, word) GROUP BY 1, 2),
phrases AS (SELECT doc_id, label, (n * (coalesce(c, 0) * 10 + least(n, 2) * {C.SUPPORT}) + bonus + defining * {C.DEFINING}) / 10 AS score FROM e LEFT JOIN g USING (doc_id, label)),
chosen AS (SELECT doc_id, generate_subscripts(l, 1) AS rank, unnest(l) AS label FROM (SELECT doc_id, {greedy('label')} AS l FROM phrases GROUP BY 1))"""


@q(f"WITH {_SENTS}, {_PHRASES} SELECT doc_id, rank, label, score FROM chosen JOIN phrases USING (doc_id, label)")
def I9_concept_phrases(s, d):
    return C.concepts(sentences(s, d), "doc_id")


_VERBS, _BOTH = "['" + "', '".join(C.VERBS) + "']", "['" + "', '".join(C.STOP + C.VERBS) + "']"
_LABEL = "array_to_string(list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda v: NOT list_contains(" + _STOP + ", v)), ' ')"
_MINED = f"""
v AS (SELECT doc_id, pos, w, list_min(list_filter(range(1, len(w) + 1), lambda i: list_contains({_VERBS}, w[i]))) AS v FROM w),
z AS (SELECT doc_id, pos, list_filter(w[1:v - 1], lambda x: NOT list_contains({_STOP}, x)) AS before, w[v + 1:] AS after FROM v WHERE v IS NOT NULL),
y AS (SELECT *, list_min(list_filter(range(1, len(after) + 1), lambda i: NOT list_contains({_BOTH}, after[i]))) AS a FROM z),
o AS (SELECT *, coalesce(list_min(list_filter(range(1, len(after) + 1), lambda i: i > a AND list_contains({_BOTH}, after[i]))), len(after) + 1) AS b FROM y),
cl AS (SELECT doc_id, array_to_string(before[greatest(len(before) - 2, 1):], ' ') AS label, {C.SUBJECT} AS bonus FROM o UNION ALL SELECT doc_id, array_to_string(after[a:least(b, a + 3) - 1], ' '), {C.OBJECT} FROM o WHERE a IS NOT NULL),
sd AS (SELECT doc_id, label, count(*) AS n, sum(bonus) AS bonus FROM cl WHERE length(label) BETWEEN 4 AND 60 GROUP BY 1, 2),
hd AS (SELECT DISTINCT doc_id, {_LABEL.format('h')} AS label FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS h FROM documents) WHERE len(string_split(h, ' ')) <= 8 AND NOT regexp_matches(h, '[.!?:;,]$')),
nm AS (SELECT DISTINCT doc_id, {_LABEL.format("replace(source || '_' || lang, '_', ' ')")} AS label FROM documents),
al AS (SELECT doc_id, label, CAST(round(score * 10) AS BIGINT) AS p, 0 AS h, 0 AS n, 0 AS bonus, 0 AS named FROM phrases UNION ALL SELECT doc_id, label, 0, 0, n, bonus, 0 FROM sd
  UNION ALL SELECT doc_id, label, 0, 1, 0, 0, 0 FROM hd WHERE length(label) BETWEEN 4 AND 60 UNION ALL SELECT doc_id, label, 0, 0, 0, 0, {C.NAMED} FROM nm WHERE length(label) BETWEEN 4 AND 60),
am AS (SELECT doc_id, label, sum(p) AS p, max(h) AS h, sum(n) AS n, sum(bonus) AS bonus, sum(named) AS named FROM al GROUP BY 1, 2),
aw AS (SELECT doc_id, label, sum(c) AS c FROM (SELECT doc_id, label, unnest(string_split(label, ' ')) AS word FROM am) JOIN f USING (doc_id, word) GROUP BY 1, 2),
av AS (SELECT doc_id, label, h, p + bonus + n * c * 10 + h * (c * 10 + {C.HEADING}) + named AS tenths FROM am JOIN aw USING (doc_id, label)),
ao AS (SELECT *, -row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, tenths DESC, label) AS score FROM av),
ap AS (SELECT doc_id, generate_subscripts(l, 1) AS rank, unnest(l) AS label FROM (SELECT doc_id, {greedy('label')} AS l FROM ao GROUP BY 1))"""


@q(f"WITH {_SENTS}, {_PHRASES}, {_MINED} SELECT doc_id, rank, label, CAST(tenths / 10 AS DOUBLE) AS score, h = 1 AS heading FROM ap JOIN av USING (doc_id, label)")
def I9_mined_concepts(s, d):
    docs = t(s, d, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("heading")).withColumn("heading", F.trim("heading"))
    lines = lines.where((F.size(F.split("heading", " ")) <= 8) & ~F.col("heading").rlike("[.!?:;,]$"))
    return C.mined(sentences(s, d), lines, docs.select("doc_id", F.concat("source", F.lit("_"), "lang", F.lit(".txt")).alias("name")), "doc_id")


_RELEVANT = """
lw AS (SELECT DISTINCT doc_id, label, unnest(regexp_extract_all(lower(label), '[a-z]{3,}')) AS word FROM chosen), sw AS (SELECT DISTINCT doc_id, pos, unnest(regexp_extract_all(lower(s), '[a-z]{3,}')) AS word FROM sent),
rel AS (SELECT doc_id, label, pos, s, overlap FROM (SELECT doc_id, label, pos, count(*) AS overlap FROM lw JOIN sw USING (doc_id, word) GROUP BY 1, 2, 3) JOIN sent USING (doc_id, pos))"""


@q(f"""
WITH {_SENTS}, {_PHRASES}, {_RELEVANT},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY overlap * 5 + CASE WHEN {_ANY('s', C.DEFINES)} THEN 4 ELSE 0 END + CASE WHEN length(s) BETWEEN 40 AND 220 THEN 3 ELSE 0 END DESC, length(s), pos) AS rank FROM rel QUALIFY rank <= 2),
z AS (SELECT *, CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END AS closed FROM r)
SELECT doc_id, label, min(CASE WHEN rank = 1 THEN closed END) AS summary, substr(string_agg(closed, ' ' ORDER BY rank), 1, 420) AS description,
  max(CASE WHEN rank = 1 THEN len(string_split(s, ' ')) / 8 + CASE WHEN {_ANY('s', C.DEFINES)} THEN 2.5 ELSE 0 END END)::DOUBLE + count(*) * 2 AS score FROM z GROUP BY 1, 2
""")
def I10_concept_payloads(s, d):
    sent = sentences(s, d)
    return C.payloads(C.concepts(sent, "doc_id"), sent, "doc_id")


@q(f"""
WITH {_SENTS}, {_PHRASES}, {_RELEVANT}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY pos) AS place FROM rel QUALIFY place <= 8),
k AS (SELECT doc_id, label, pos, 'claim' AS kind, 2 AS most FROM p WHERE place <= 4 AND {_ANY('s', C.CLAIMS)} UNION ALL SELECT doc_id, label, pos, 'example', 2 FROM p WHERE {_ANY('s', C.EXAMPLES)} UNION ALL SELECT doc_id, label, pos, 'misconception', 1 FROM p WHERE {_ANY('s', C.MISCONCEPTIONS)})
SELECT doc_id, label, kind, row_number() OVER (PARTITION BY doc_id, label, kind ORDER BY pos) AS rank, pos FROM k QUALIFY rank <= most
""")
def I16_concept_depth(s, d):
    sent = sentences(s, d)
    return C.depth_of(C.concepts(sent, "doc_id"), sent, "doc_id")


@q(f"""
WITH {_SENTS}, c AS (SELECT doc_id, pos, 'What is ' || regexp_extract(s, '[A-Za-z]{{3,}}', 0) || '?' AS front, s AS answer FROM sent WHERE length(s) >= 24),
u AS (SELECT doc_id, arg_min({{'f': front, 'a': answer}}, pos) AS c, min(pos) AS pos FROM c GROUP BY doc_id, lower(front), lower(answer)),
l AS (SELECT doc_id, list_reduce(list([c] ORDER BY pos), lambda a, b: CASE WHEN len(a) >= 16 OR len(list_filter(a, lambda x: lower(x.f) = lower(b[1].f) OR lower(x.a) = lower(b[1].a))) > 0 THEN a ELSE list_concat(a, b) END) AS l FROM u GROUP BY 1)
SELECT doc_id, rank, c.f AS front, md5(c.a) AS answer FROM (SELECT doc_id, generate_subscripts(l, 1) AS rank, unnest(l) AS c FROM l)
""")
def I13_deck(s, d):
    front = F.concat(F.lit("What is "), F.regexp_extract("s", "[A-Za-z]{3,}", 0), F.lit("?"))
    cards = sentences(s, d).where(F.length("s") >= 24).select("doc_id", F.col("pos").alias("place"), front.alias("front"), F.col("s").alias("answer"))
    return C.deck(cards, "doc_id").select("doc_id", "rank", "front", F.md5("answer").alias("answer"))


@q("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'match' WHEN 1 THEN CASE WHEN length(p_type) > 5 THEN 'match' ELSE 'unconfirmed' END WHEN 2 THEN 'unconfirmed' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'unconfirmed' WHEN 5 THEN 'match' WHEN 6 THEN 'match' ELSE 'unconfirmed' END AS state FROM part
""")
def V16_caption_state(s, d):
    k, word = F.col("p_partkey") % 8, F.initcap(F.substring_index("p_name", " ", 1))
    kind = F.initcap(F.lower("p_type"))
    name = F.concat(F.initcap("p_name"), F.lit(" Union v. "), kind, F.lit(" Co."))
    initials = F.concat(F.array_join(F.regexp_extract_all(F.initcap("p_name"), F.lit("[A-Z]"), F.lit(0)), ""), F.lit("U"))
    plaintiff = F.when(k == 2, "Zyx").when(k == 3, "Zyx").when(k == 4, "Ng").when(k == 5, initials).when(k == 7, "M.L.").otherwise(word)
    defendant = F.when(k == 1, F.concat(F.substring(kind, 1, 3), F.lit("."))).when(k == 3, "Qwv").when(k == 6, "").otherwise(kind)
    return t(s, d, "part").select("p_partkey", C.caption_state(plaintiff, defendant, name).alias("state"))


@q("""
SELECT p_partkey, '12 f.3d ' || (p_partkey + 100) AS cite, (['match', 'match', 'mismatch', 'unconfirmed', 'missing', 'match'])[p_partkey % 6 + 1] AS state FROM part
""")
def V16_V24_captions_in_texts(s, d):
    """Captions within sentences: the case's name, its abbreviations and initials, other parties, one of two, an unknown citation, after a signal."""
    k, word = F.col("p_partkey") % 6, F.initcap(F.substring_index("p_name", " ", 1))
    side = F.get(F.array(F.concat(word, F.lit(" Manufacturing Co. v. National Labor Board")), F.concat(word, F.lit(" Mfg. Co. v. NLB")), F.lit("Zyx Qwv v. Ostrich of Rome"), F.concat(word, F.lit(" Manufacturing v. Ostrich of Rome")), F.lit("Any v. Other"), F.concat(F.lit("See also "), word, F.lit(" v. National Bd."))), k.cast("int"))
    cite = F.concat(F.lit("12  F.3d "), (F.col("p_partkey") + 100).cast("string"))
    text = F.concat(F.when(k == 5, "").otherwise("as the court held in "), side, F.lit(", "), cite, F.lit(", costs are shared."))
    p = t(s, d, "part")
    cases = p.where(k != 4).select(cite.alias("cite"), F.concat(word, F.lit(" Manufacturing Company v. National Labor Board")).alias("name"))
    return C.caption_states(p.select("p_partkey", text.alias("body")), "p_partkey", "body", cases).select("p_partkey", "cite", "state")


@q(f"""
WITH {_SENTS}, f AS (SELECT doc_id, s FROM sent WHERE pos = 1), quotes AS (SELECT doc_id AS grp, 0 AS quote_id, s FROM f UNION ALL SELECT doc_id - 1, 1, s FROM f WHERE doc_id > 0),
c AS (SELECT doc_id AS grp, doc_id FROM documents UNION ALL SELECT doc_id, doc_id + 1 FROM documents WHERE doc_id % 3 = 0),
x AS (SELECT grp, quote_id, count(*) AS n, bool_or(contains(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')), trim(regexp_replace(lower(s), '[ \\t\\n\\r]+', ' ', 'g')))) AS found FROM quotes JOIN c USING (grp) JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT grp, quote_id, coalesce(n, 0) AS looked_at FROM quotes LEFT JOIN x USING (grp, quote_id) WHERE NOT coalesce(found, false)
""")
def V26_unattributed_quotes(s, d):
    """A group quotes its own document and the next one's first sentence; one group of three cites both."""
    docs, own = t(s, d, "documents"), F.col("doc_id")
    first = sentences(s, d).where("pos = 1")
    quotes = first.select(own.alias("grp"), F.lit(0).alias("quote_id"), F.col("s").alias("quote")).unionByName(first.where("doc_id > 0").select((own - 1).alias("grp"), F.lit(1).alias("quote_id"), F.col("s").alias("quote")))
    cites = docs.select(own.alias("grp"), "doc_id").unionByName(docs.where(own % 3 == 0).select(own.alias("grp"), (own + 1).alias("doc_id")))
    return C.unattributed(quotes, cites, docs, "grp", "doc_id", "text")


@q("""
WITH l AS (SELECT l_orderkey, list(chr(97 + (l_linenumber + l_partkey % 2)::INT - 1) ORDER BY l_linenumber, l_partkey, l_suppkey) AS l FROM lineitem GROUP BY 1)
SELECT l_orderkey, length(list_reduce(list_prepend('', l), lambda a, b: CASE WHEN b = chr(97 + length(a)::INT) THEN a || b ELSE a END)) AS run FROM l
""")
def W9_marker_runs(s, d):
    """An order's lines as markers a, b, c, ..., every line of an odd part one letter on."""
    mark = F.char(F.lit(96) + F.col("l_linenumber") + F.col("l_partkey") % 2)
    g = t(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", mark.alias("m")).alias("e")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return g.select("l_orderkey", folds.marker_run(F.transform("e", lambda e: e["m"])).alias("run"))


@q("SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) AS n FROM events GROUP BY 1")
def M1_job_states(s, d):
    return E.current_state(t(s, d, "events"), "user_id", "event_id", "event_type")


@q("SELECT event_id, user_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def M2_cursor_page(s, d):
    return E.after_cursor(t(s, d, "events"), "event_id", 500, 100).select("event_id", "user_id")


@q("SELECT doc_id, CASE WHEN min(toxic) IS NULL THEN 'could_not_check' WHEN min(toxic) = 0 THEN 'a' ELSE 'b' END AS verdict FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id")
def M4_verdict_per_claim(s, d):
    found = t(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 0, "a").when(F.col("toxic") == 1, "b").alias("verdict"))
    return E.verdicts(t(s, d, "documents").select("doc_id"), found, "doc_id", "verdict")


@q("SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) IN ('click', 'login')")
def M5_unfinished_jobs(s, d):
    return E.unfinished(t(s, d, "events"), "user_id", "event_id", "event_type", ("click", "login"))
