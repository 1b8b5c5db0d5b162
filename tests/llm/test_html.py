"""Main text: generated pages whose article is known, the probes of odd markup, and what the clustering decides."""

import random
import re
import time
from html import unescape

import pytest

from attestlake.llm import html, queries
from attestlake.llm.common import table


def sentence(r, n):
    return " ".join(r.choice("river stone market paper garden winter signal copper village harbour".split()) for _ in range(n)).capitalize() + "."


def page(seed):
    """(html, main text) of a page in one of several layouts."""
    r = random.Random(seed)
    blocks = [("h1", sentence(r, 5))]
    for _ in range(r.randint(4, 9)):
        blocks.append(("p", sentence(r, r.choice([3, 30, 45, 60]))))
    blocks.insert(3, ("h2", sentence(r, 3)))
    body = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    items = [sentence(r, 2) for _ in range(3)]
    body += "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
    text = "\n".join([x for _, x in blocks] + items)
    links = "".join(f'<li><a href="/{i}">{sentence(r, 1)}</a></li>' for i in range(6))
    top = f"<nav><ul>{links}</ul></nav><div class='top-ad'>{sentence(r, 4)}</div>"
    end = f"<div id='comments'><p>{sentence(r, 20)}</p></div><footer><p>{sentence(r, 8)}</p></footer><script>var a = '<p>no</p>';</script>"
    form = f"<form><label>{sentence(r, 2)}</label><input></form><aside>{sentence(r, 12)}</aside>"
    plain = "".join(f"<div><a href='/{i}'>{sentence(r, 1)}</a> <a href='/x'>{sentence(r, 1)}</a></div>" for i in range(5))
    shape = seed % 4
    if shape == 0:
        inner = f"{top}<article>{body}{form}</article>{end}"
    elif shape == 1:
        inner = f"<div class='layout has-sidebar'>{top}<div id='text'>{body}</div>{form}</div>{end}"
    elif shape == 2:
        inner = f"{top}<main><article>{body}</article></main>{plain}{end}"
    else:
        inner = f"{plain}<div><div>{body}</div></div>{plain}{end}"
    return f"<html><head><title>{sentence(r, 4)}</title><style>p {{}}</style></head><body>{inner}</body></html>", text


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    source, text = page(seed)
    assert html.main_text(source) == text


def test_clustering_decides(monkeypatch):
    changed = 0
    monkeypatch.setattr(html, "content_lines", lambda lines: [True] * len(lines))
    for seed in range(3, 40, 4):
        source, text = page(seed)
        changed += html.main_text(source) != text
    assert changed == 10


LONG = "A long sentence of the article with many words that nothing else on this page comes near to. " * 4


@pytest.mark.parametrize(("source", "text"), [
    (f'<div class="layout has-sidebar"><div class="sidebar">Side.</div><h1>T</h1><p>{LONG}</p></div>', f"T\n{LONG.strip()}"),
    (f"<article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n{LONG.strip()}"),
    (f'<div><div class="entry-header"><h1>T</h1></div><p>{LONG}</p></div>', f"T\n{LONG.strip()}"),
    (f'<article><p>{LONG}</p><p class="advert">Buy.<p>End.</p></article><ul><li class="comment">{LONG}</li></ul>', f"{LONG.strip()}\nEnd."),
    (f"<article><p>{LONG}</p></article><article><p>Two {LONG}</p></article>", f"{LONG.strip()}\nTwo {LONG.strip()}"),
    (f"<div><p>Lead-in.</p><blockquote>{LONG}</blockquote></div>", f"Lead-in.\n{LONG.strip()}"),
    (f"<body><header><h1>Site</h1></header><article><h1>T</h1><p>{LONG}</p></article></body>", f"T\n{LONG.strip()}"),
    ("<p>a&nbsp;&amp;&#x20AC;\n b<br>c", "a &€ b c"), ("", ""), (None, ""), ("<br><img src=x>", ""), ("<script>x", ""), ("no tags at all", "no tags at all"),
])
def test_probes(source, text):
    assert html.main_text(source) == text


def test_long_page():
    many = "".join(f"<p>{LONG}</p>" for _ in range(3000))
    assert html.main_text(f"<article>{many}</article>").count("\n") == 2999
    assert html.main_text("<p>" + "x" * 2_000_000) == "x" * 2_000_000
    html.main_text("<div>" * 3000 + LONG)


def test_all_pages_of_the_table(spark):
    """The pages keep their text in one article each, of h1, p and inline markup; read here by patterns."""
    got = {r.page_id: r for r in queries.op7_html_text(spark, "/root/testdata/sf0.01").collect()}
    pages = table(spark, "/root/testdata/sf0.01", "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.search("<article>(.*)</article>", r.html, re.S).group(1)
        blocks = re.split(r"</?(?:h1|p|ul|li|div)\b[^>]*>", re.sub(r"<br>", " ", inner))
        text = "\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks) if x)
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


@pytest.mark.parametrize("block", ['<p class="alert">Warning of frost.</p>', '<p id="notice">Notice period.</p>', '<h2 id="search">Search</h2>', '<h2 class="header">Head</h2>'])
def test_blocks_of_an_article_name_their_own_text(block):
    inner = re.sub("<[^>]+>", "", block)
    assert html.main_text(f"<article><p>{LONG}</p>{block}<p>{LONG}</p></article>") == f"{LONG.strip()}\n{inner}\n{LONG.strip()}"


@pytest.mark.parametrize("wrap", ["<ul>{}</ul>", "<div>{}</div>", "<section><div>{}</div></section>"])
def test_link_blocks_without_class_words_go_by_the_ratio(monkeypatch, wrap):
    links = "".join(f'<li><a href="/{i}">River stone</a>' if "ul" in wrap else f'<div><a href="/{i}">River stone</a></div>' for i in range(8))
    source = f"<article><h1>T</h1><p>{LONG}</p>{wrap.format(links)}<p>{LONG}</p><ul><li>One.<li>Two <a href='/'>x</a> and more.</ul></article>"
    assert html.main_text(source) == f"T\n{LONG.strip()}\n{LONG.strip()}\nOne.\nTwo x and more."
    monkeypatch.setattr(html, "content_lines", lambda lines: [True] * len(lines))
    assert html.main_text(source).count("River stone") == 8


@pytest.mark.parametrize("part", ["<div>some words here", '<div class="ad">some words', "<ul><li><ul><div><li>x</li>", "<div><h1>a</h1>", "<div>x</section>"])
def test_deep_pages_take_linear_time(part):
    start = time.perf_counter()
    html.main_text(part * 40_000)
    assert time.perf_counter() - start < 15


def test_null_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a</p>", "y"), (1, "<p>a</p>", "y")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html.extract(df).collect()) == [(1, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html.extract(df.where("false")).count() == 0
