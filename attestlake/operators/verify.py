"""Claims against source sentences: candidates by typed keys, clause rules, near copies, quotes, and the fold of states.

A claim meets only the sentences of its scope (a draft's own sources) with which it shares a key; the pair rules are
column expressions over the two texts, and every fold over candidates is an aggregate of fixed size.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestlake.functions import anchors as A
from attestlake.functions import text as X
from attestlake.kernel.sentences import quote_segments, repair_quote
from attestlake.operators.attest import GRAM, gram_rows, normal
from attestlake.operators.lineage import spread
from attestlake.operators.relational import exploded

#: Candidates of one claim, and of all claims of a draft, above which a draft is refused.
MOST_CANDIDATES, MOST_PAIRS = 4_000, 500_000
VERIFIED, OPEN, ALTERED = "verified", "could_not_check", "altered"


def keys(text: Column | str) -> Column:
    """V1: the typed keys of a sentence: its fact tokens (t:), anchor values (v:), skeleton (s:) and folded text (n:)."""
    text = F.col(text) if isinstance(text, str) else text
    tokens = F.transform(X.fact_tokens(text), lambda w: F.concat(F.lit("t:"), w))
    values = F.transform(F.filter(A.figures(text), lambda a: a["canonical"].isNotNull()), lambda a: F.concat(F.lit("v:"), a["type"], F.lit("="), a["canonical"]))
    whole = F.array(F.concat(F.lit("s:"), F.md5(X.figure_skeleton(text))), F.concat(F.lit("n:"), F.md5(X.fold(text))))
    return F.array_distinct(F.concat(tokens, values, whole))


def postings(rows: DataFrame, scope: str, id_: str, text: str) -> DataFrame:
    """scope, key, id_: the inverted index of a table of sentences."""
    return exploded(rows, keys(text), "key", scope, id_)


def candidates(claims: DataFrame, sentences: DataFrame, scope: str) -> DataFrame:
    """Scope, claim_id, sentence_id of all pairs that share a key. Columns: scope, claim_id, claim; scope, sentence_id, sentence."""
    c, s = postings(claims, scope, "claim_id", "claim"), postings(sentences, scope, "sentence_id", "sentence")
    return c.join(s, [scope, "key"]).select(scope, "claim_id", "sentence_id").distinct()


def over_bounds(claims: DataFrame, sentences: DataFrame, scope: str, most: int = MOST_CANDIDATES, most_in_all: int = MOST_PAIRS) -> DataFrame:
    """Scope, claim_id, n (its posting lists' lengths, summed without dedupe), refused. Lists are counted, no pair is made."""
    c = postings(claims, scope, "claim_id", "claim")
    lengths = postings(sentences, scope, "sentence_id", "sentence").groupBy(scope, "key").agg(F.count("*").alias("n"))
    per = c.join(lengths, [scope, "key"]).groupBy(scope, "claim_id").agg(F.sum("n").alias("n"))
    total = per.groupBy(scope).agg(F.sum("n").alias("total"))
    out = claims.select(scope, "claim_id").join(per, [scope, "claim_id"], "left").join(total, scope, "left")
    n, whole = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))
    return out.select(scope, "claim_id", n.cast("long").alias("n"), ((n > most) | (whole > most_in_all)).alias("refused"))


# --- one claim against one clause ------------------------------------------------------------------------------------


def _values(found: Column, kind: str) -> Column:
    return F.array_distinct(F.transform(F.filter(found, lambda a: a["type"] == kind), lambda a: a["canonical"]))


def _contained(a: Column, b: Column) -> Column:
    pair = lambda x, y: F.concat(x, F.lit("<"), y)
    known = F.array(*[F.lit(f"{x}<{y}") for x, y in A.CONTAINED])
    return F.array_contains(known, pair(a, b)) | F.array_contains(known, pair(b, a))


def _same(kind: str, a: Column, b: Column) -> Column:
    """Equal values; durations of different units may differ by 5 %."""
    if kind != "duration":
        return a == b
    x, y = a.cast("double"), b.cast("double")
    return (a == b) | (F.abs(x - y) <= 0.05 * F.greatest(x, y)) & ((x % 365 == 0) != (y % 365 == 0)) | (F.abs(x - y) <= 0.05 * F.greatest(x, y)) & ((x % 30 == 0) != (y % 30 == 0))


def compared(pairs: DataFrame, claim: str = "claim", clause: str = "clause") -> DataFrame:
    """V5-V8: pairs with results, an array of (type, result) for each parametric type of the claim.

    silent: the clause has no such value; multi: more than one value on a side; contained: one place lies in the other;
    equal; differ. Figures are compared as cents, units, days and basis points; polarity by stem and noun.
    """
    x = pairs.withColumn("a1", A.anchors(claim)).withColumn("a2", A.anchors(clause))
    made = []
    for kind in A.PARAMETRIC:
        if kind == "polarity":
            continue
        v, w = _values(F.col("a1"), kind), _values(F.col("a2"), kind)
        one, two = F.get(v, F.lit(0)), F.get(w, F.lit(0))
        inner = _contained(one, two) if kind == "governing_law" else F.lit(False)
        result = F.when(F.size(v) == 0, None).when(F.size(w) == 0, "silent").when((F.size(v) > 1) | (F.size(w) > 1), "multi").when(inner, "contained").when(_same(kind, one, two), "equal").otherwise("differ")
        made.append(F.struct(F.lit(kind).alias("type"), result.alias("result")))
    # Polarity: by stem and noun; both signs of one on a side are two values.
    stem = lambda p: F.regexp_replace(p, "[+-]$", "")
    p, r = _values(F.col("a1"), "polarity"), _values(F.col("a2"), "polarity")

    def polar(v: Column) -> Column:
        other = F.filter(r, lambda w: stem(w) == stem(v))
        mine = F.filter(p, lambda w: stem(w) == stem(v))
        return F.struct(F.concat(F.lit("polarity:"), stem(v)).alias("type"), F.when(F.size(other) == 0, "silent").when((F.size(mine) > 1) | (F.size(other) > 1), "multi").when(F.array_contains(other, v), "equal").otherwise("differ").alias("result"))

    results = F.filter(F.concat(F.array(*made), F.array_distinct(F.transform(p, polar))), lambda t: t["result"].isNotNull())
    return x.withColumn("results", results).drop("a1", "a2")


def disposition(results: Column) -> Column:
    """V5: contradiction, then multi_value, unconfirmed, present, not_found. Figures that match are located, never affirmed."""
    has = lambda f: F.exists(results, f)
    figure = lambda t: t["type"].isin(*A.FIGURES)
    return (
        F.when(has(lambda t: t["result"] == "differ"), "contradiction").when(has(lambda t: t["result"].isin("multi", "contained")), "multi_value")
        .when(has(lambda t: (t["result"] == "silent") & ~figure(t)), "unconfirmed").when(has(lambda t: (t["result"] == "equal") & ~figure(t)), "present").otherwise("not_found")
    )


def adjudicated(results: DataFrame, keys_: list[str]) -> DataFrame:
    """V9: one disposition for a claim over all its clauses.

    A contradiction stands only if no clause carries the claim's value of that type, else the clauses are in conflict.
    Counts by type, then a maximum by claim: both are aggregated before the shuffle.
    """
    rows = exploded(results, F.col("results"), "r", *keys_).select(*keys_, "r.*")
    by = rows.groupBy(*keys_, "type").agg(*[F.max(F.col("result") == v).alias(v) for v in ("differ", "equal", "multi", "contained")])
    figure = F.col("type").isin(*A.FIGURES)
    rank = (
        F.when(F.col("differ") & ~F.col("equal"), 6).when(F.col("differ"), 5).when(F.col("equal") & ~figure, 4).when(F.col("multi") | F.col("contained"), 3).when(F.col("equal"), 2).otherwise(1)
    )
    names = F.create_map(*[F.lit(x) for x in (6, "contradiction", 5, "conflicting_clauses", 4, "present", 3, "multi_value", 2, "located", 1, "not_found")])
    out = by.groupBy(*keys_).agg(F.max(rank).alias("k"))
    return out.select(*keys_, F.element_at(names, F.col("k")).alias("disposition"))


def percent_subjects(pairs: DataFrame, claim: str = "claim", clause: str = "clause") -> DataFrame:
    """V8: pairs with subjects: contradiction if a subject has another percentage in the clause, present if all of the claim's match, else not_found."""
    got = lambda c: F.transform(F.filter(A.figures(c), lambda a: (a["type"] == "percent") & a["subject"].isNotNull()), lambda a: F.struct(F.lower(a["subject"]).alias("s"), a["canonical"].alias("v")))
    x = pairs.withColumn("p1", got(claim)).withColumn("p2", got(clause))
    other = lambda a: F.filter("p2", lambda b: b["s"] == a["s"])
    differs = F.exists("p1", lambda a: (F.size(other(a)) > 0) & ~F.exists(other(a), lambda b: b["v"] == a["v"]))
    return x.withColumn("subjects", F.when(differs, "contradiction").when((F.size("p1") > 0) & F.forall("p1", lambda a: F.exists(other(a), lambda b: b["v"] == a["v"])), "present").otherwise("not_found")).drop("p1", "p2")


# --- copies with changed figures or words ----------------------------------------------------------------------------


def residue(claims: DataFrame, sentences: DataFrame, scope: str) -> DataFrame:
    """Scope, claim_id, state: claims and sentences of one skeleton (figures masked), compared figure by figure.

    altered if every such sentence has other figures, verified if one has the same.
    """
    side = lambda df, text: df.withColumn("skeleton", F.md5(X.figure_skeleton(text))).withColumn("values", F.transform(A.figures(text), lambda a: F.concat_ws("=", a["type"], a["canonical"])))
    c = side(claims, "claim").where("size(values) > 0").select(scope, "claim_id", "skeleton", F.col("values").alias("v"))
    s = side(sentences, "sentence").select(scope, "skeleton", F.col("values").alias("w")).distinct()
    j = c.join(s, [scope, "skeleton"]).where("size(v) = size(w)")
    return j.groupBy(scope, "claim_id").agg(F.when(F.max(F.col("v") == F.col("w")), VERIFIED).otherwise(ALTERED).alias("state"))


def ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with ratio, the similarity of two texts' skeletons by matching blocks. A small helper on pairs that already met."""

    @F.pandas_udf("double")
    def by_blocks(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("ratio", F.round(by_blocks(X.figure_skeleton(a), X.figure_skeleton(b)), 6))


def altered_figures(pairs: DataFrame, a: str = "claim", b: str = "clause", least: float = 0.9) -> DataFrame:
    """V6: pairs with altered: on near copies (skeleton ratio of at least least, as many figures, one of them shared), the claim's figures that the clause lacks."""
    said = lambda c: X.matches(c, r"[$€£]?[0-9][0-9,]*(?:\.[0-9]+)?%?")
    x = ratio(pairs, a, b).withColumn("f", said(a)).withColumn("g", said(b))
    near = (F.col("ratio") >= least) & (F.size("f") == F.size("g")) & F.arrays_overlap("f", "g")
    return x.withColumn("altered", F.when(near, F.array_sort(F.array_except("f", "g"))).otherwise(F.array().cast("array<string>"))).drop("f", "g")


NEGATIONS, RHETORICAL, SWAPS = ("not", "never", "no"), ("only", "just", "merely"), (("cannot", "can"), ("without", "with"))


def flips(claims: DataFrame, sentences: DataFrame, scope: str) -> DataFrame:
    """Scope, claim_id, sentence_id, kind, name (the claim's words of the run) of pairs whose words are the same but for one run.

    Such a pair shares its first or its last four words (all, if fewer), which is the key they meet by. restated: no
    difference; negation: one side has a negation more, the prefix un- or non-, or a pair like with and without; name: capitalized words against
    others, not at the start; else other.
    """
    side = lambda df, id_, text: df.select(scope, id_, X.edge_tokens(text).alias("t")).where("size(t) > 0")
    ends = lambda c: F.array_distinct(F.array(F.concat(F.lit("a:"), F.array_join(F.slice(F.transform(c, F.lower), 1, 4), " ")), F.concat(F.lit("z:"), F.array_join(F.slice(F.reverse(F.transform(c, F.lower)), 1, 4), " "))))
    c = side(claims, "claim_id", "claim").select(scope, "claim_id", F.col("t").alias("x"), F.explode(ends(F.col("t"))).alias("key"))
    s = side(spread(sentences), "sentence_id", "sentence").select(scope, "sentence_id", F.col("t").alias("y"), F.explode(ends(F.col("t"))).alias("key"))
    # dealt by number, so that adaptive execution leaves the work on the pairs to all tasks
    n = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = c.join(s, [scope, "key"]).drop("key").repartition(n, scope, "claim_id", "sentence_id").dropDuplicates([scope, "claim_id", "sentence_id"])
    m = F.least(F.size("x"), F.size("y"))
    low = lambda t: F.transform(t, F.lower)
    same = lambda p, q, most: F.aggregate(F.zip_with(p, q, lambda v, w: F.coalesce(v == w, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, e: F.struct(F.when(a["on"] & e, a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & e).alias("on")), lambda a: F.least(a["n"], most))
    j = j.withColumn("p", same(low("x"), low("y"), m)).withColumn("q", same(F.reverse(low("x")), F.reverse(low("y")), m - F.col("p")))
    run = lambda t: F.slice(t, F.col("p") + 1, F.greatest(F.size(t) - F.col("p") - F.col("q"), F.lit(0)))
    j = j.withColumn("u", run("x")).withColumn("v", run("y")).where((F.col("p") + F.col("q") > 0) & (F.col("p") + F.col("q") >= 0.5 * m))
    text = lambda t: F.lower(F.array_join(t, " "))
    # "not only", "not just" and "not merely" deny nothing
    follows = F.lower(F.coalesce(F.when(F.size("u") == 1, F.get("x", F.col("p") + 1)).otherwise(F.get("y", F.col("p") + 1)), F.lit("")))
    negated = (F.size("u") + F.size("v") == 1) & F.concat(text("u"), text("v")).isin(*NEGATIONS) & ~follows.isin(*RHETORICAL)
    bare = lambda t: F.when((F.size(t) == 2) & F.lower(F.get(t, F.lit(0))).isin("a", "an"), F.slice(t, 2, 1)).otherwise(F.col(t))
    prefixed = lambda t, r: (F.size(bare(t)) == 1) & (F.size(bare(r)) == 1) & (F.length(text(bare(r))) >= 4) & text(bare(t)).isin(F.concat(F.lit("un"), text(bare(r))), F.concat(F.lit("non-"), text(bare(r))))
    swapped = prefixed("u", "v") | prefixed("v", "u")
    for one, two in SWAPS:
        swapped = swapped | ((text("u") == one) & (text("v") == two)) | ((text("u") == two) & (text("v") == one))
    capital = lambda t: (F.size(t) > 0) & F.forall(t, lambda w: w.rlike("^[A-Z]"))
    name = capital("u") & capital("v") & (F.col("p") > 0) & ~F.startswith(text("u"), text("v")) & ~F.startswith(text("v"), text("u"))
    kind = F.when((F.size("u") == 0) & (F.size("v") == 0), "restated").when(negated | swapped, "negation").when(name, "name").otherwise("other")
    return j.select(scope, "claim_id", "sentence_id", kind.alias("kind"), F.array_join("u", " ").alias("name"))


# --- quotes, placement, grounding ------------------------------------------------------------------------------------


def quote_states(claims: DataFrame, sources: DataFrame, scope: str) -> DataFrame:
    """V3: scope, claim_id, quote, state. Columns: scope, claim_id, claim; scope, source_id, text, complete.

    verified: one source holds all phrases of the quote (its first letter in either case); altered: some phrase is in no
    source and all sources are complete; else could_not_check.
    """
    q = claims.select(scope, "claim_id", F.explode(F.array_distinct(X.quoted_spans(normal("claim")))).alias("quote")).withColumn("phrases", X.quote_phrases("quote")).where("size(phrases) > 0")
    bodies = sources.select(scope, "source_id", normal("text").alias("body"))
    # A word inside a phrase, between spaces, is a whole word of any source that holds the phrase: the longest one is the
    # key they meet by. Phrases of one or two words have none: the last of two words begins a word of the source, and one
    # word lies inside one; what follows its first letter, which stands in either case, is the key.
    words = F.split("phrase", " ")
    inner = F.transform(F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    ph = q.select(scope, "claim_id", "quote", F.size("phrases").alias("n"), F.posexplode("phrases").alias("i", "phrase")).withColumn("key", F.array_max(inner)["w"])
    has = exploded(bodies, F.array_distinct(F.split("body", " ")), "key", scope, "source_id").join(ph.where("key IS NOT NULL").select(scope, "key").distinct(), [scope, "key"], "left_semi")
    said = F.filter(words, lambda w: w != "")
    gram = F.when(F.size(said) > 1, F.substring(F.element_at(said, -1), 1, GRAM)).otherwise(F.substring(F.try_element_at(said, F.lit(1)), 2, GRAM))
    short = ph.where("key IS NULL").withColumn("key", F.coalesce(gram, F.lit("")))
    lengths = sorted(r.n for r in short.select(F.length("key").alias("n")).distinct().collect())  # at most GRAM + 1 values
    met = ph.join(has, [scope, "key"]).drop("key")
    if lengths:
        inside = gram_rows(bodies, lengths, scope, "source_id").join(short.select(scope, "key").distinct(), [scope, "key"], "left_semi")
        met = met.unionByName(short.join(inside, [scope, "key"]).drop("key"))
    held = met.join(bodies, [scope, "source_id"]).where(F.exists(X.first_letter_variants(F.col("phrase")), lambda v: F.contains(F.col("body"), v)))
    whole = held.groupBy(scope, "claim_id", "quote", "n", "source_id").agg(F.countDistinct("i").alias("k")).groupBy(scope, "claim_id", "quote").agg(F.max(F.col("k") == F.col("n")).alias("all"))
    found = held.groupBy(scope, "claim_id", "quote").agg(F.countDistinct("i").alias("found"))
    pool = sources.groupBy(scope).agg(F.min(F.coalesce("complete", F.lit(False))).alias("complete"))
    g = q.select(scope, "claim_id", "quote", F.size("phrases").alias("n")).join(whole, [scope, "claim_id", "quote"], "left").join(found, [scope, "claim_id", "quote"], "left").join(pool, scope, "left")
    absent = F.coalesce("found", F.lit(0)) < F.col("n")
    return g.select(scope, "claim_id", "quote", F.when(F.col("all"), VERIFIED).when(absent & F.col("complete"), ALTERED).otherwise(OPEN).alias("state"))


def placed(claims: DataFrame, drafts: DataFrame, scope: str) -> DataFrame:
    """Scope, claim_id, start of a claim that stands exactly once in its draft (folded text); null where it stands nowhere or more than once."""
    j = claims.select(scope, "claim_id", X.fold("claim").alias("c")).join(drafts.select(scope, X.fold("draft").alias("d")), scope, "left")
    n = (F.length("d") - F.length(F.replace("d", F.col("c")))) / F.length("c")
    return j.select(scope, "claim_id", F.when((F.col("c") != "") & (n == 1), F.instr("d", F.col("c")) - 1).cast("int").alias("start"))


def ungrounded_sections(drafts: DataFrame, sources: DataFrame, scope: str) -> DataFrame:
    """Scope, section: sections a draft names that none of its sources does, where these name any."""
    named = lambda df, c: exploded(df, F.array_distinct(F.transform(F.filter(A.figures(c), lambda a: a["type"] == "section"), lambda a: a["canonical"])), "section", scope)
    s = named(sources, "text").distinct()
    return named(drafts, "draft").distinct().join(s, [scope, "section"], "left_anti").join(s.select(scope).distinct(), scope, "left_semi")


def fabricated_terms(drafts: DataFrame, sources: DataFrame, scope: str) -> DataFrame:
    """Scope, term: capitalized words inside sentences, and numbers, of a draft that no source of its scope holds. Commas and dots of numbers don't count."""
    terms = lambda c: F.array_distinct(F.concat(F.filter(X.matches(c, r"(?<=[a-z,;] )[A-Z][a-z]{2,}"), lambda w: w != ""), F.transform(X.matches(c, r"\d[\d.,]*\d|\d"), lambda w: F.regexp_replace(w, "[.,]", ""))))
    all_words = F.array_distinct(F.concat(X.matches("text", r"[A-Za-z]+"), F.transform(X.matches("text", r"\d[\d.,]*\d|\d"), lambda w: F.regexp_replace(w, "[.,]", ""))))
    t = drafts.select(scope, F.explode(terms("draft")).alias("term")).distinct()
    return t.join(sources.select(scope, F.explode(all_words).alias("term")).distinct(), [scope, "term"], "left_anti")


def best_spans(claims: DataFrame, sentences: DataFrame, scope: str, least: float = 0.1) -> DataFrame:
    """Scope, claim_id, sentence_id, jaccard of the sentence whose words are nearest, if they are least alike.

    Of texts that are `least` alike, the rarest words of both (all but least of them, and one) share one: only these make
    texts meet, so the words that most texts hold bring none together. The likeness is that of all words.
    """
    tok = lambda c: F.array_distinct(X.tokens(c))
    c, s = claims.select(scope, "claim_id", tok("claim").alias("a")), sentences.select(scope, "sentence_id", tok("sentence").alias("b"))
    each = lambda df, id_, words: df.select(scope, id_, F.size(words).alias("size"), F.explode(words).alias("w"))
    mine, theirs = each(c, "claim_id", "a"), each(s, "sentence_id", "b")
    often = theirs.join(mine.select(scope, "w").distinct(), [scope, "w"], "left_semi").groupBy(scope, "w").agg(F.count("*").alias("df"))

    def rare(df: DataFrame, id_: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(scope, id_).orderBy(F.coalesce("df", F.lit(0)), "w"))
        return df.join(often, [scope, "w"], "left").withColumn("place", rank).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9)) + 1).select(scope, id_, "w")

    met = rare(mine, "claim_id").join(rare(theirs, "sentence_id"), [scope, "w"]).select(scope, "claim_id", "sentence_id").distinct()
    j = met.join(c, [scope, "claim_id"]).join(s, [scope, "sentence_id"])
    jac = F.round(X.jaccard("a", "b"), 6)
    best = j.withColumn("jac", jac).where(F.col("jac") >= least).groupBy(scope, "claim_id").agg(F.min(F.struct((-F.col("jac")).alias("minus"), "sentence_id")).alias("m"))
    return best.select(scope, "claim_id", "m.sentence_id", (-F.col("m.minus")).alias("jaccard"))


def quote_repairs(pairs: DataFrame, quote: str, source: str) -> DataFrame:
    """Pairs with repaired: the source's own text for a quote, found by its normal form (NFKC, plain marks, case
    and spaces folded), else by the longest common run of 95 % and 40 characters; null if neither."""

    @F.pandas_udf("string")
    def own_text(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([repair_quote(a or "", b or "") for a, b in zip(q, s, strict=True)])

    return pairs.withColumn("repaired", own_text(quote, source))


def quote_autopsy(pairs: DataFrame, quote: str, source: str) -> DataFrame:
    """V4: pairs with segments: the quote in tiles (kind: verbatim, altered or neutral; text), word by word."""

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def tiles(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "text": t} for k, t in quote_segments(a or "", b or "")] for a, b in zip(q, s, strict=True)])

    return pairs.withColumn("segments", tiles(quote, source))
