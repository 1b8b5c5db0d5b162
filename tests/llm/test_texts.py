"""HTML extraction and secret scans on small fixtures."""

import re

from attestlake.llm import html, linededup, quality, secrets, urls

PAGE = """<!doctype html><html><head><title>T</title><style>p {x: y}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li>About</li></ul></nav>
<div class="cookie-notice">We use cookies, a lot of them, on every single page that you ever read here.</div>
<div id="content"><article><h1>Caf&eacute; &amp; bar</h1><p>First   paragraph,
with <b>bold</b> words and a good deal of text that goes on for a while.</p><p>Short.</p>
<div class="advert">Buy this thing now, it is a very good thing and you will like it a lot.</div>
<p>Second paragraph, also with a good deal of text &lt;that&gt; goes on for a while.</p>
<div class="comments"><p>A reader says that this is a good page, and goes on for a while about it.</p></div></article></div>
<aside class="sidebar">Other pages that you may like as well, and so on and on.</aside><form><p>Your name</p><input></form>
<footer><p>All rights reserved, by the people who made this page and all the other ones.</p></footer></body></html>"""
MAIN = "Café & bar\nFirst paragraph, with bold words and a good deal of text that goes on for a while.\nShort.\nSecond paragraph, also with a good deal of text <that> goes on for a while."


def test_html_main_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "u", "", None), (4, "u", "<p></p>", None), (None, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[1].text == got[None].text == MAIN and got[1].n_chars == len(MAIN)
    assert all(got[i].text == "" and got[i].n_chars == 0 for i in (2, 3, 4))
    assert html.extract(pages.where("false")).count() == 0


def test_html_long_page():
    body = "".join(f"<p>Paragraph number {i} has some words.</p>" for i in range(20_000))
    text = html.main_text(f"<html><body><nav>Menu</nav><article>{body}</article></body></html>")
    assert text.count("\n") == 19_999 and "Menu" not in text


def test_html_whole_content_cluster():
    a, b, c = ("Words of a sentence that goes on for a while, " * k for k in (4, 7, 13))
    page = lambda body: html.main_text(f"<html><body><nav><a>Menu</a></nav>{body}<footer>Rights</footer></body></html>")
    want = lambda *x: "\n".join(t.strip() for t in x)
    assert page(f"<div><p>Intro</p><blockquote><p>{a}</p><p>{b}</p></blockquote></div>") == want("Intro", a, b)
    assert page(f"<div><p>{a}</p><ul><li>{b}</li><li>{c}</li></ul></div>") == want(a, b, c)
    assert page(f"<div><p>{c}</p></div><div><p>{b}</p></div>") == want(c, b)
    assert page(f"<article><h2>One</h2><p>{a}</p></article><article><p>{c}</p></article><article><p>{b}</p></article>") == want("One", a, c, b)
    assert page(f"<main><p>Site</p><article><p>{a}</p><p>Short.</p><article>{b}</article></article></main><p>Out</p>") == want(a, "Short.", b)
    assert html.main_text(f"<article>{a}</article><article>{b}</article>") == want(a, b)


def test_secret_candidates_match_plain_search(spark):
    texts = {i: t for i, (t, _, _) in enumerate(secrets.labelled_findings(300, seed=21))}
    texts |= {1000: "", 1001: "é \U0001f600 token = abcDEF123456789 x", 1002: "a" * 40_000 + " key: " + "b1" * 3000, 1003: "no candidates here: none"}
    docs = spark.createDataFrame([*texts.items(), (1004, None)], "doc_id long, text string")
    want = set()
    for i, t in texts.items():
        for m in re.finditer(secrets.CANDIDATE, t):
            if m[1] or re.search("[0-9]", m[2]):
                want.add((i, m.start(2), m[1] or "", m[2]))
    got = [(r.doc_id, r.start, r.name, r.value) for r in secrets.candidates(docs).collect()]
    assert set(got) == want and len(got) == len(want)


def test_secret_scan_on_findings_not_trained_on(spark):
    rows = [(i, *x) for i, x in enumerate(secrets.labelled_findings(600, seed=99))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, label string")
    found = {r.doc_id for r in secrets.scan(docs, secrets.train(spark), path=docs["path"]).collect() if r.secret}
    right = sum((i in found) == (label == "s") for i, _, _, label in rows)
    assert right / len(rows) >= 0.93


def test_secret_values_of_secret_names_are_whole(spark):
    want = {
        'password = "hunter2"': ("password", "hunter2"), 'pwd: "Summer2024!"': ("pwd", "Summer2024!"), '{"password": "correcthorsebattery"}': ("password", "correcthorsebattery"),
        "DB_PASSWORD=p@ss;w0rd! x": ("DB_PASSWORD", "p@ss;w0rd!"), "spring.datasource.password=abc, y": ("spring.datasource.password", "abc"), "{'client-secret': 'two words'}": ("client-secret", "two words"),
        '"token":"a\\"b"': ("token", 'a\\"b'), 'é \U0001f600 apiKey:       "ü7", "user": "bob"': ("apiKey", "ü7"), 'password = "open end': ("password", "open"),
    }
    none = ['password: ""', "password:\nnext", "author: Ann", "user: bob", '"name": "correcthorsebattery"']
    texts = dict(enumerate([*want, *none]))
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.name, r.value) for r in secrets.candidates(docs).collect()}
    assert got == {(i, texts[i].rindex(v), n, v) for i, (n, v) in enumerate(want.values())}


def test_short_secrets_not_trained_on(spark):
    rows = [(i, *x) for i, x in enumerate(secrets.assigned_findings(400, seed=98))]
    rows += [(1000, 'password = "hunter2"', "", "s"), (1001, 'pwd: "Summer2024!"', "", "s"), (1002, '"password": "correcthorsebattery"', "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, label string")
    found = {r.doc_id for r in secrets.scan(docs, secrets.train(spark), path=docs["path"]).collect() if r.secret}
    assert {1000, 1001, 1002} <= found
    assert sum((i in found) == (label == "s") for i, _, _, label in rows) / len(rows) >= 0.85


def test_made_columns_replace_columns_so_named(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", "y", "z"), (None, None, None, None, None)], "doc_id long, text string, Score string, n_lines string, url string")
    cut = linededup.dedup_lines(docs)
    assert cut.columns == ["doc_id", "text", "Score", "url", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(r.n_lines for r in cut.collect()) == [1, 2]
    scored = quality.score(docs, quality.BoostedTrees(0.0))
    assert scored.columns == ["doc_id", "text", "n_lines", "url", "score", "predicted"] and {r.score for r in scored.collect()} == {0.5}
    judged = urls.judge(docs.withColumn("host", docs["url"]), [("com", "/", "block")])
    assert [r.host for r in judged.collect()] == ["", ""]


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
