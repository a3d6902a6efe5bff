import html
import re

import pytest

from gaugeworks.llm import html_text

A, B, C = ("First paragraph with a good number of plain words in it, so that it is long. " * k for k in (3, 5, 2))
A, B, C = A.strip(), B.strip(), C.strip()
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Mail</a></li><li><a href="/d">Shop</a></li></ul>'
BODY = f"<h1>Title</h1><p>{A}</p><p>Short.</p><p>{B}</p>"
WANT = ["Title", A, "Short.", B]

SHAPES = {
    "article": (f"<nav>{MENU}</nav><article>{BODY}</article><footer>&copy; us</footer>", WANT),
    "no article": (f"<div>{MENU}</div><div>{BODY}</div><div>{MENU}</div>", WANT),
    "no wrapper": (f"<div>{MENU}</div>{BODY}<div>{MENU}</div>", WANT),
    "no-sidebar": (f'<nav>{MENU}</nav><div class="content no-sidebar">{BODY}</div>', WANT),
    "has-sidebar": (f'<div class="has-sidebar"><nav>{MENU}</nav><article>{BODY}</article><div class="sidebar">{C}</div></div>', WANT),
    "sticky-header": (f'<div class="sticky-header"><header>{MENU}</header><article>{BODY}</article></div>', WANT),
    "with-footer": (f'<div class="with-footer"><article>{BODY}</article><footer>{C}</footer></div>', WANT),
    "body share": (f'<nav>{MENU}</nav><div class="article-body share"><article>{BODY}</article></div>', WANT),
    "share around text": (f'<nav>{MENU}</nav><div class="share">{BODY}</div>', WANT),
    "entry-header": (f'<article><div class="entry-header"><h1>Title</h1></div><p>{A}</p><p>Short.</p><p>{B}</p></article>', WANT),
    "header in article": (f"<article><header><h1>Title</h1></header><p>{A}</p><p>Short.</p><p>{B}</p></article>", WANT),
    "site-header": (f'<div class="site-header"><p>{C}</p></div><main>{BODY}</main>', WANT),
    "comments": (f'<article>{BODY}<div class="comment-list"><p>{C}</p></div></article>', WANT),
    "unnamed advert": (f"<nav>{MENU}</nav><div>Buy this now.</div><article>{BODY}</article>", WANT),
    "sections": (f"<nav>{MENU}</nav><section><h1>Title</h1><p>{A}</p></section><section><p>Short.</p></section><section><p>{B}</p></section>", WANT),
    "form around page": (f"<form><div>{MENU}</div>{BODY}</form>", WANT),
    "form inside": (f"<article>{BODY}<form><label>Mail</label><button>Go</button></form></article>", WANT),
    "two articles": (f"<nav>{MENU}</nav><article>{BODY}</article><article><p>{C}</p></article>", [*WANT, C]),
    "roles": (f'<div role="navigation">{MENU}</div><div>{BODY}</div><div role="contentinfo">{C}</div>', WANT),
    "cells": (f"<table><tr><td>{MENU}</td><td>{BODY}</td></tr></table>", WANT),
    "list in text": (f"<nav>{MENU}</nav><article>{BODY}<ul><li>One &amp; two</li><li>Three</li></ul></article>", [*WANT, "One & two", "Three"]),
    "hidden": (f'<article>{BODY}<p hidden>{C}</p></article><script>var a = "<p>{C}</p>";</script><style>p {{}}</style>', WANT),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    body, want = SHAPES[name]
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"
    assert html_text.content_lines(page) == want
    assert html_text.content_lines(page.replace("<", "\n<")) == want


def test_without_the_ratio_menus_stay(monkeypatch):
    """On pages whose markup names nothing, only the ratio tells a menu from the text."""
    plain = ("no article", "no wrapper", "form around page", "cells")
    monkeypatch.setattr(html_text, "scores", lambda lines: html_text.np.zeros(len(lines)))
    for name in plain:
        body, want = SHAPES[name]
        assert html_text.content_lines(f"<body>{body}</body>") != want


def test_smoothing_and_clusters():
    values = html_text.np.array([0.0, 0.0, 0.0, 5.0, 1.0, 5.0, 5.0, 0.0, 0.0])
    smooth = html_text.smoothed(values)
    assert smooth[4] > smooth[1] + 2 and len(smooth) == len(values)  # a short line between long ones
    assert html_text.clusters(html_text.np.array([1.0, 1.2, 5.0, 5.2])) == pytest.approx((1.1, 5.1))


def blocks(page):
    """The main text of a page of the given tables, by patterns: every article's headings and paragraphs."""
    out = []
    for body in re.findall("<article>(.*?)</article>", page or "", re.S):
        for part in re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<br\s*/?>", " ", body)):
            text = " ".join(html.unescape(re.sub("<[^>]*>", "", part)).split())
            out += [text] * (text != "")
    return "\n\n".join(out)


def test_all_pages_by_patterns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: blocks(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_deep_and_wide_pages():
    assert len(html_text.content_lines("<div>word " * 20_000)) == 20_000
    assert len(html_text.content_lines('<div class="menu">word ' * 5_000)) > 0
    assert html_text.content_lines("<p>" + "word " * 300_000) == [("word " * 300_000).strip()]
