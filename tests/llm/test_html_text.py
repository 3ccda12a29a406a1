import html
import random
import re
import time

import duckdb
import pytest

from tidelog.llm import html_text
from tidelog.llm.html_text import Path, _alike, blocks, extract_text, main_text

ARTICLE = "A title\nFirst paragraph, with some words and marks. It is long enough to count.\nSecond one; shorter.\nok"
SITE = """<html><body><div id="header">Site name</div><ul class="menu"><li><a href=x>Home</a><li><a href=y>News</a></ul><div class="content has-sidebar"><h1>A title</h1>
<p>First paragraph, with some <b>words</b> and <i>marks</i>. It is long enough to count.<p>Second one; shorter.<p>ok</div>
<div class="comments"><p>I like this article, it is so very good, thanks a lot for it.</p></div><div class="sidebar"><p>Other things, to read, here.</p></div><div id=footer>Copyright</div></body></html>"""
MAIN = """<body><div class="cookie-notice">We use cookies. Accept, please.</div><main><nav><a>x</a></nav><header><h1>T &amp; U</h1></header><p>Body&nbsp;text  here,
 yes.</p><aside>No.</aside><div class="ad"><p>Buy!</p></div><form><p>Name</p></form><p style="display: none">hidden</p><table><tr><td>a<td>b</table>
<section id="comments"><article class="comment"><p>hi there</p></article></section><script>var x = "<p>no</p>";</script></main><footer>(c)</footer></body>"""


@pytest.mark.parametrize(
    "page, expected",
    [
        (SITE, ARTICLE),
        (MAIN, "T & U\nBody text here, yes.\na\nb"),
        (None, ""), ("", ""), (" \n ", ""), ("plain  text\nonly", "plain text only"), ("<p>one<p>two", "one\ntwo"), ("</div></p>x<", "x<"),
        ("<article><p>a < b &lt; c &#233;&am</p></article>", "a < b < c é&am"), ("<nav><a href=x>only a menu</a></nav>", ""),
        ("<article><p>" + "long, " * 50_000 + "</p></article>", "long, " * 49_999 + "long,"), ("<script>never closed", ""), ("<!-- never closed", ""),
        ("<p>a<br>b</p>", "a b"), ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<article><p><b>x<br><p>y</p></article>", "x\ny"),
    ],
)
def test_main_text(page, expected):
    assert main_text(page) == expected


def test_paths_follow_the_markup():
    assert [(b.path.labels(), b.text) for b in blocks("<body><div class=x><p>a<p>b</div>c</body>")] == [
        (("body", "div.x", "p"), "a"), (("body", "div.x", "p"), "b"), (("body",), "c")
    ]


def plain(page):
    """What the test pages' articles hold."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = re.split("</?(?:p|h1)>", re.sub("</?b>|<br>", "", inside))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_query_gives_the_articles(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    rows = duckdb.connect().execute(f"SELECT page_id, url, html FROM '{path}'").fetchall()
    got = extract_text(spark.read.parquet(path)).collect()
    expected = [(i, u, t, len(t)) for i, u, t in ((i, u, plain(h)) for i, u, h in rows)]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "clash"), (1, None, None, "clash"), (None, "u", "<p>x", "clash")], "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in extract_text(df).collect()), key=str) == [(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)]
    assert extract_text(df.where("false")).collect() == []


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<article><p>Some text.</p><div class="notice"><p>Read this notice.</p></div><div class=notices>More.</div></article>', "Some text."),
        ('<article data-headline="The hidden cost of rain"><p>Some text.</article>', "Some text."),
        ('<article title="hidden gems" data-id="comments-12"><p>Some text.</article>', "Some text."),
        ("<article data-x='class=\"sidebar\"'><p>Some text.<p hidden>no<p class = \"ad\">no</article>", "Some text."),
        ('<article class="no-sidebar has-comments with-ads"><p>Some text.</article>', "Some text."),
    ],
)
def test_names_are_whole_attributes(page, expected):
    assert main_text(page) == expected


PARAGRAPHS = [f"Paragraph {k} tells a part of the tale, and it does so with many words, some marks; it goes on for a while, as paragraphs do." for k in range(4)]


def test_pages_without_names():
    text = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    menu = "".join(f"<div class=m{k}><a href=x>Link number {k}</a></div>" for k in range(6))
    side = "<div class=k9><div class=q1>Weather today</div><div class=q2>Buy now</div></div>"
    foot = "<div class=z3>Copyright 2024 Example Inc. All rights reserved.</div>"
    page = f"<body><div class=a1>{menu}</div><div class=b2><h1>The tale</h1>{text}<ul><li>short item</li></ul><p>ok</p></div>{side}{foot}</body>"
    assert main_text(page) == "\n".join(["The tale", *PARAGRAPHS, "short item", "ok"])
    cells = f"<body><table><tr><td bgcolor=x><a href=x>Home</a> <a href=y>News</a></td><td>{text}</td></tr><tr><td>Copyright Example</td></tr></table></body>"
    assert main_text(cells) == "\n".join(PARAGRAPHS)


def test_split_articles():
    a, b, c, d = (f"<p>{x}</p>" for x in PARAGRAPHS)
    page = f"<body><h1>The tale</h1><div class=entry-content>{a}</div><div class=ad><p>Buy!</p></div><div class=entry-content>{b}{c}</div><p>{PARAGRAPHS[3]}</p></body>"
    assert main_text(page) == "\n".join(["The tale", *PARAGRAPHS])
    page = f"<body><h1>The tale</h1><p>{PARAGRAPHS[0]}</p><div class=content>{b}</div><div class=x7>{c}{d}</div></body>"
    assert main_text(page) == "\n".join(["The tale", *PARAGRAPHS])
    sections = "".join(f"<section class=story>{x}</section>" for x in (a, b, c, d))
    assert main_text(f"<body>{sections}<article><a href=x>Another tale</a></article></body>") == "\n".join(PARAGRAPHS)


def test_scores_decide(monkeypatch):
    text = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    menu = "".join(f"<div class=m{k}>Item {k}</div>" for k in range(6))
    page = f"<body><div class=a1>{menu}</div><div class=b2>{text}</div><div class=z3>Copyright 2024 Example Inc</div></body>"
    assert main_text(page) == "\n".join(PARAGRAPHS)
    monkeypatch.setattr(html_text, "scores", lambda found: [1.0] * len(found))
    assert "Item 3" in main_text(page) and "Copyright" in main_text(page)


def test_common_parts_of_paths():
    rng, root = random.Random(3), Path("#root", None)
    paths = [root]
    for _ in range(400):
        up = rng.choice(paths[-30:])
        paths.append(up.child(rng.choice("abc")))
    for _ in range(2000):
        a, b = rng.choice(paths), rng.choice(paths)
        n = next((k for k, (x, y) in enumerate(zip(a.labels(), b.labels())) if x != y), min(a.depth, b.depth) - 1)
        assert _alike(a, b) == 2 * (n + 1) / (a.depth + b.depth)


@pytest.mark.parametrize(
    "unit", ["<" + "a" * 20, "<a ", '<a "', "<a '>", "<div>", "<center>x", "<ul><li>x", "<p>x", "<script", "<script></script ", "</p>", "&", "<!--", "<!", "<div>x, y."]
)
def test_hostile_pages_take_time_in_proportion(unit):
    page = unit * (400_000 // len(unit))
    start = time.perf_counter()
    main_text(page)
    # at a quadratic cost each would take minutes
    assert time.perf_counter() - start < 15
