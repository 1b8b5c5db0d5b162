"""Small cases that queries over a part of the rows would miss."""

from attestlake.operators import attest
from attestlake.plans import tables, texts, verify


def test_relevance_meets_every_item(spark):
    docs = spark.createDataFrame([(0, "tail word"), (1, "none of it"), (2, "7"), (3, None), (40, "other tail")], "doc_id long, text string")
    items = spark.createDataFrame([(0, "else"), (199, "Tail end"), (200, None)], "item_id long, text string")
    assert {r.doc_id: r.relevant for r in texts.relevant_to_any(docs, items).collect()} == {0: True, 1: False, 2: True, 3: False, 40: True}


def test_item_is_found_in_every_document(spark):
    runs = ["one two  three four five six", "ne two thre", "Three four", "", "not there at all", None]
    docs = ["zero One two three\nfour five sixteen", "one two three four five", "x", None, "zero one two three four five six"]
    a = spark.createDataFrame([*enumerate(runs)], "item_id long, text string")
    b = spark.createDataFrame([(i + 100, x) for i, x in enumerate(docs)], "doc_id long, text string")
    got = {(r.item_id, r.doc_id, r.present) for r in texts.present_in(a, b).collect()}
    fold = lambda x: " ".join((x or "").lower().split())
    pairs = {(i, j + 100, True) for i, x in enumerate(runs) if x is not None for j, y in enumerate(docs) if fold(x) in fold(y)}
    assert got == pairs | {(4, None, False), (5, None, False)} and len(pairs) == 2 + 3 + 3 + 5


def test_all_orders_are_sorted_with_nulls_last(spark):
    sf = "/root/testdata/sf0.001"
    rows = tables.QUERIES["T3_nulls_last_all"](spark, sf).collect()
    assert len(rows) == tables.t(spark, sf, "orders").count() and any(r.o_orderdate is None for r in rows)
    assert rows == sorted(rows, key=lambda r: (r.o_orderdate is None, r.o_orderdate or 0, r.o_orderkey))


def test_jaccard_of_items_with_distant_ids(spark):
    items = spark.createDataFrame([(0, "red sun red"), (7, "red moon"), (90, "moon sun sea"), (91, "none"), (92, None)], "item_id long, text string")
    assert {tuple(r) for r in tables.jaccard_pairs(items).collect()} == {(0, 7, 0.333333), (0, 90, 0.25), (7, 90, 0.25)}


def test_quotes_of_another_table_in_short_turns(spark):
    items = spark.createDataFrame([(1, "Yes. It was so, they said! Not here."), (2, None)], "item_id long, text string")
    turns = spark.createDataFrame([(5, 0, "Yes."), (5, 1, "yes. It  was so, they said!"), (6, 0, None)], "conv_id long, turn long, text string")
    want = {("Yes.", 5, 0, True), ("It was so, they said!", 5, 1, True), ("Not here.", None, None, False)}
    assert {tuple(r)[1:] for r in texts.quotes_in(items, turns).collect()} == want


def test_anchor_rows_hold_defined_terms_quantities_and_counts(spark):
    text = 'The cargo (the "Cargo") weighs 20 kg. Inspectors counted 12,500 crates of Cargo for $30.'
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = attest.anchor_rows(docs, "doc_id", "text").collect()
    assert all(text[r.start : r.end] == r.text for r in rows)
    assert {(r.type, r.text) for r in rows} >= {("defined_term", "Cargo"), ("quantity", "20 kg"), ("count", "12,500"), ("money", "$30")}
    assert [r.start for r in rows if r.type == "defined_term"] == [text.index("Cargo"), text.rindex("Cargo")]


def test_citations_meet_the_clusters_of_suppliers_and_parts(spark, tmp_path):
    tables_of = {
        "supplier": ([(2,), (42,), (43,), (2,), (None,)], "s_suppkey long"),
        "part": ([(4,), (5,), (6,), (5,), (1234567,), (None,)], "p_partkey long"),
        # orders that 3 divides cite no cluster by that
        "lineitem": ([(1, 1, 2, 5), (1, 2, 43, 4), (3, 1, 2, 4), (3, 2, 2, 6), (4, 1, 82, 5), (4, 2, 42, 6), (6, 1, 3, 7), (7, 1, 43, 1234567)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long"),
    }
    for name, (rows, schema) in tables_of.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.l_orderkey, r.l_linenumber): (r.cite, r.known) for r in verify.QUERIES["V24_J22_citation_lookup"](spark, str(tmp_path)).collect()}
    assert got == {
        (1, 1): ("2 F.3d 5", True), (1, 2): ("3 F.3d 4", True), (3, 1): ("2 F.3d 4", False), (3, 2): ("2 F.3d 6", True), (4, 1): ("2 F.3d 5", True),
        (4, 2): ("2 F.3d 6", True), (6, 1): ("3 F.3d 7", False), (7, 1): ("3 F.3d 1234567", True),
    }
