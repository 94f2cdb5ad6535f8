"""Operator 11: pages of several layouts whose article is known."""

from __future__ import annotations

import os
import re

import pytest

from papyra.llm.html_text import TOKEN, blocks, density, extract, main_text, parse

WORDS = "Rivers carry sand and silt from the hills to the sea, and where they slow down the load settles."
TEXT = [f"{WORDS} Part {k} says so, too." for k in range(6)]
MENU = "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(12))
P = "".join(f"<p>{t}</p>" for t in TEXT)


def joined(*lines):
    return "\n".join(lines)


LAYOUTS = {
    "declared article": (f"<body><nav><ul>{MENU}</ul></nav><article><h1>Sand</h1>{P}</article><footer>&copy; us</footer></body>", joined("Sand", *TEXT)),
    "names only": (f'<body><div class="site-header">Our paper</div><div id="mainMenu"><ul>{MENU}</ul></div><div class="post-body"><h2>Sand</h2>{P}</div><div class="right-sidebar"><p>About us and our many friends.</p></div><div id="footer">All rights</div></body>', joined("Sand", *TEXT)),
    "no names": (f"<body><table><tr><td><ul>{MENU}</ul></td><td><div><h1>Sand</h1>{P}</div></td></tr></table></body>", joined("Sand", *TEXT)),
    "parts": (f"<body><div><ul>{MENU}</ul></div><div><h1>Sand</h1><div>{''.join(f'<p>{t}</p>' for t in TEXT[:3])}</div><div>{''.join(f'<p>{t}</p>' for t in TEXT[3:])}</div></div></body>", joined("Sand", *TEXT)),
    "furniture inside": (
        f'<article><header><h1>Sand</h1></header><p>{TEXT[0]}</p><div class="ad-box ad">Buy sand</div><aside>See also</aside><p>{TEXT[1]}</p><form><label>Mail</label><input><button>Go</button></form>'
        f'<div class="cookie-notice">We use cookies</div><section id="comments"><article><p>{WORDS} I think so.</p></article></section></article>',
        joined("Sand", TEXT[0], TEXT[1]),
    ),
    "comments after it": (f'<main><article><h1>Sand</h1>{P}</article><div class="user-comments">{P}{P}{P}</div></main>', joined("Sand", *TEXT)),
    "page in a form": (f'<form action="/"><div class="has-sidebar page"><article><h1>Sand</h1>{P}</article></div></form>', joined("Sand", *TEXT)),
    "unclosed": (f"<title>x</title><ul>{MENU}</ul><article><h1>Sand</h1>" + "".join(f"<p><b>{t}<br>" for t in TEXT), joined("Sand", *TEXT)),
    "line breaks": (f"<div><ul>{MENU}</ul></div><div>{'<br><br>'.join(TEXT)}</div>", joined(*TEXT)),
    "hidden": (f'<article><p>{TEXT[0]}</p><p hidden>no</p><p style="display: none">no</p><div aria-hidden="true">no</div><noscript>no</noscript><p>{TEXT[1]}</p></article>', joined(*TEXT[:2])),
    "sections named like furniture": (
        f'<article class="commentary"><h1>Sand</h1><h2 id="menu">Menu of sands</h2><section id="discussion"><p>{TEXT[0]}</p></section><section id="related-work"><p>{TEXT[1]}</p></section><div class="related-posts"><p>{TEXT[2]}</p></div><div class="top-bar">Sign</div><div class="no-ads">Kept.</div></article>',
        joined("Sand", "Menu of sands", TEXT[0], TEXT[1], "Kept."),
    ),
    "main": (f'<div role="navigation">{MENU}</div><main><section><h2>One</h2>{P}</section><section><h2>Two</h2><p>Short.</p></section></main>', joined("One", *TEXT, "Two", "Short.")),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout(name):
    page, want = LAYOUTS[name]
    assert main_text(page) == want


CASES = {
    None: "", "": "", "   ": "", "plain  text": "plain text", "<nav>only a menu</nav>": "", "<!-- a > b --><p>x</p>": "x", "<!--><p>x</p>": "x",
    "<p>a &amp; b &lt;c&gt; &#8217; &eacute;&nbsp;&copy &am": "a & b <c> ’ é © &am", "<p>1 < 2 and <3</p>": "1 < 2 and <3", "<p>a<b>b</b><i>c</i> d</p>": "abc d", "<p>a\n\t b<br>c</p>": "a b c",
    "<p>a<script>var t='</p>';</script>b<style>p{}</style></p>": "ab", "<script>never closed <p>x": "", "<p title='a>b' class=x>a</p>": "a", "<p title=\"open>a</p>": "a", "<td>a<td>b": "a\nb", "<ul><li>a<ul><li>b</ul><li>c</ul>": "a\nb\nc",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc", "<p>a</div></p></b>b": "a\nb", "<b><p>a</b> b</p>": "a b", "<dl><dt>a<dd>b<dt>c</dl>": "a\nb\nc", "<P>A</P><DIV>b</DIV>": "A\nb", "<p>a</p": "a", "<": "<",
    "<![CDATA[x]]><p>y": "y", "<?php echo ?><p>y": "y", "<h1>a<h2>b": "a\nb", "<p>a<p><p>b": "a\nb", "a<hr>b": "a\nb", "<pre>a\n  b</pre>": "a b",
}


@pytest.mark.parametrize("page", list(CASES))
def test_small_pages(page):
    assert main_text(page) == CASES[page]


def test_deep_long_and_odd_pages():
    deep = "<div>" * 20_000 + "x"
    assert main_text(deep) == "x"
    long = "<article>" + "<p>word &amp; word</p>" * 60_000 + "</article>"
    assert main_text(long) == "\n".join(["word & word"] * 60_000)
    for odd in ("<a href='" * 20_000, '<p x="' * 20_000, "<!" * 30_000, "<" * 50_000, "<!--" * 20_000, "</" * 30_000, "<p =" * 20_000):
        main_text(odd)


def test_nothing_but_tags_is_lost():
    page = "<div>" + "".join(f"<p>{t} &quot;{k}&quot;</p>" for k, t in enumerate(TEXT)) + "</div>"
    assert "\n".join(blocks(parse(page))) == joined(*(f'{t} "{k}"' for k, t in enumerate(TEXT)))
    assert "".join(m[0] for m in TOKEN.finditer(page)) == page


def test_density_falls_with_links():
    free, linked = density(400, 4, 0, 0, 500, 3000), density(400, 4, 360, 4, 500, 3000)
    assert free > linked > 0
    assert density(0, 3, 0, 0, 5, 9) == 0 and density(30, 0, 0, 0, 0, 30) == 30


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, "a"), (2, None, "<p>x", "b"), (2, None, "<p>x", "b"), (None, "v", "", "c")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(rows).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (2, None, "x", 1), (2, None, "x", 1), (None, "v", "", 0)], key=repr)
    empty = extract(rows.limit(0))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_query_against_the_tables_own_layout(spark):
    """The tables have one layout: an article of a heading and paragraphs."""
    import html

    from papyra.llm.html_text import op11_html_extraction

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op11_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</h1>", inner)]
        assert got[i]["text"] == "\n".join(x for x in lines if x), i
        assert got[i]["n_chars"] == len(got[i]["text"])
