"""Readers on odd texts: CSV against the standard library's reader, HTML by hand."""

import csv
import io
import re

from attestlake.sources import documents, markup

CSVS = [
    None, "", "\n", "a,b\n1,2", 'a,b\n"x, y",2\n', 'h\n"two\nlines"\n', 'h,i\n"he said ""no""",3', "a,b\n1\n1,2,3\n", "a\r\nb\r\n\r\nc", 'a,b\n "x",y', 'a,b\nx"y,"z"w', "a,b,\n,,\n , \n", 'a\n"never ends, \n here', "é,ü\n€,\U0001f600",
    'q\n""\n"",x', "only header", 'a;b\n1;2', '"a"\n"b"', ",\n1,2", "\n\nx,y\n1,2", 'a,b\n"1"" 2","3\r\n4"', "a,b\n" + ",".join(f'"{i},{i}"' for i in range(300)),
]


def by_library(text, sep=","):
    out, head = [], []
    for n, row in enumerate(csv.reader(io.StringIO(text or "", newline=""), delimiter=sep), 1):
        values = [re.sub(r"[ \t\n\x0b\f\r]+", " ", v).strip(" ") for v in row]
        if n == 1:
            head = values
        cells = [(n, i, "cell", f"{head[i - 1] if i <= len(head) else f'Column {i}'}: {v}") for i, v in enumerate(values, 1) if v]
        out += cells + ([(n, 0, "row", "\n".join(c[3] for c in cells))] if cells else [])
    return sorted(out)


def test_csv_like_the_library(spark):
    df = spark.createDataFrame(list(enumerate(CSVS)), "id int, text string")
    got = {}
    for r in documents.csv_elements(df, "id", "text").collect():
        got.setdefault(r.id, []).append((r.row, r.col, r.kind, r.value))
    wrong = [(t, sorted(got.get(i, [])), by_library(t)) for i, t in enumerate(CSVS) if sorted(got.get(i, [])) != by_library(t)]
    assert not wrong, wrong[:2]
    tabs = spark.createDataFrame([(1, 'a\tb\n"x\ty"\t2')], "id int, text string")
    assert sorted(tuple(r)[1:] for r in documents.csv_elements(tabs, "id", "text", "\t").collect()) == by_library('a\tb\n"x\ty"\t2', "\t")


def test_long_csv(spark):
    text = "a,b\n" + '"one, ""two""\nthree",4\n' * 20_000 + '"' + '""' * 1000 + '"'
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert documents.csv_elements(df, "id", "text").count() == len(by_library(text))


def test_html_elements(spark):
    cases = [
        ("<p>a &amp; b&nbsp;&#8364;<p>c", [("p", "a & b €", None), ("p", "c", None)]),
        ("<h1>T</h1><ul><li>one<li>two<ul><li>in</ul>more<li>three</ul>x", [("h1", "T", "T"), ("li", "one", "T"), ("li", "two in more", "T"), ("li", "in", "T"), ("li", "three", "T")]),
        ("<nav><p>no</p></nav><header>no</header><p>yes<script>p('</p>')</script><style>p{}</style></p><footer><li>no", [("p", "yes", None)]),
        ("<table><caption>C<tr><td>a<td>b<tr><td><p>c</table><p>d", [("table", "C a b c", None), ("caption", "C", None), ("p", "c", None), ("p", "d", None)]),
        ("<p>a<div>b</div>c<h2>H</h2><P CLASS=x>d</P></p>", [("p", "a", None), ("h2", "H", "H"), ("p", "d", "H")]),
        ("<p>a<br>b<b>c</i></b></p></p></div>", [("p", "a b c", None)]), ("<p> \n </p><li></li>", []), ("", []), (None, []), ("<!-- <p>x</p> --><p>y", [("p", "y", None)]), ("no tags", []), ("<p", []),
    ]
    df = spark.createDataFrame([(i, h, "x") for i, (h, _) in enumerate(cases)], "id long, html string, kind string")
    got = {}
    for r in sorted(documents.html_elements(df, "id", "html").collect(), key=lambda r: r.place):
        got.setdefault(r.id, []).append((r.kind, r.value, r.section))
    wrong = [(h, got.get(i, []), w) for i, (h, w) in enumerate(cases) if got.get(i, []) != w]
    assert not wrong, wrong
    assert documents.html_elements(df.where("false"), "id", "html").count() == 0


def test_references_without_a_semicolon():
    page = "<h1>a &amp; b &#8364; &amp</h1><p>x&ampy &lt;&#38;&#38 &; & &unknown; &quot"
    assert [e[1] for e in markup.elements(page, closed=True)] == ["a & b € &amp", "x&ampy <&&#38 &; & &unknown; &quot"]
    assert [e[1] for e in markup.elements(page)] == ["a & b € &", 'x&y <&& &; & &unknown; "']


def test_deep_markup_is_linear():
    assert len(markup.elements("<div>" * 40_000 + "<p>x")) == 1
    assert len(markup.elements("<p>x" * 40_000)) == 40_000
    assert markup.elements("<ul><li>" * 2_000 + "x")[0] == ("li", "x", None)
    assert len(markup.elements("<li>a</b></p>" * 40_000)) == 40_000
