"""Queries that verify texts against sources."""

from __future__ import annotations

from attestlake.operators import attest, detect
from attestlake.plans.base import Book, t

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
_N = r"trim(regexp_replace(translate(coalesce(text, ''), '‘’“”‐‑‒–—', '''''""-----'), '[ \t\n\r]+', ' ', 'g'), ' ')"


@book(rf"""
WITH c AS (SELECT item_id, claim FROM (SELECT item_id, unnest(string_split(regexp_replace({_N}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS claim FROM benchmark) WHERE claim <> ''),
s AS (SELECT ' ' || {_N} || ' ' AS body FROM documents),
h AS (SELECT claim, EXISTS (SELECT 1 FROM s WHERE contains(body, ' ' || claim || ' ')) AS ok FROM (SELECT DISTINCT claim FROM c))
SELECT i.item_id, count(ok) AS n_claims, count(*) FILTER (WHERE ok) AS n_verified,
  CASE WHEN count(ok) = 0 THEN 'could_not_check' WHEN bool_and(ok) THEN 'verified' ELSE 'altered' END AS state
FROM (SELECT DISTINCT item_id FROM benchmark) i LEFT JOIN (SELECT * FROM c JOIN h USING (claim)) x USING (item_id) GROUP BY i.item_id
""")
def V3_benchmark_leak_verification(s, d):
    return attest.attest_verbatim(t(s, d, "benchmark"), t(s, d, "documents"), "item_id", "text", "text", "doc_id")


@book()
def C1_C4_contradictions(s, d):
    # C1 to C8 by now
    return detect.scan(t(s, d, "documents"), "doc_id", "text")
