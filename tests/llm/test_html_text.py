import html
import re

import pytest
from brute import ordered

from quillmesh.llm import html_text
from quillmesh.llm.queries import QUERIES

LONG = "Alpha beta, gamma delta epsilon, zeta eta theta iota kappa lambda, mu nu xi omicron pi."
CASES = [
    (None, ""),
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>a<b>b</b>\n c<br>d", "ab c d"),
    ("<!-- <article>x</article> --><article>y</article>", "y"),
    ("<article><p>x &lt;b&gt; &#233;&eacute; &copy</p></article>", "x <b> éé ©"),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><p>yes</p>", "yes"),
    (f"<body><header>Site</header><div id=main><h1>T</h1><p>{LONG}</p><p>short</p><ul><li>one, two</li></ul></div>"
     f"<div class='sidebar'>{LONG}</div><div class=comments><p>{LONG} {LONG}</p></div><div class='cookie-notice'>We use</div>"
     f"<form><p>{LONG}</p></form><footer><p>{LONG}</p></footer></body>", f"T {LONG} short one, two"),
    (f"<article><p>{LONG}</p><section class='comments'><p>{LONG}</p></section></article><aside>no</aside>", LONG),
    (f"<nav><p>{LONG}</p></nav><div><p>{LONG}</p></div>", LONG),
    (f"<div><ul><li><a href=1>{LONG}</a><li><a href=2>{LONG}</a><li><a href=3>{LONG}</a></ul></div><div><p>{LONG}</p></div>", LONG),
    ("<article><p><b>One.<br><p>Two.<p>Three</article><footer>no</footer>", "One. Two. Three"),
    ('<article data-x="a>b"><p title=\'</article>\'>in</p></article>out', "in"),
    ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ("<article><table><tr><td>x<td>y<tr><td>z</table></article>", "x y z"),
    ("<p>cut off <a href='", "cut off"),
    ("<article><p>one</p></article><div role=navigation>menu</div><div hidden>secret</div>", "one"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_cases(page, text):
    assert html_text.main_text(page) == text


NAMES = ["search-algorithm", "related-work", "legal-issues", "social-impact", "feedback", "navigation", "discussion"]


@pytest.mark.parametrize("name", NAMES)
def test_titles_as_names(name):
    """Ids made from titles, and classes that may as well be titles, drop no article text."""
    page = f"<article><h2 id='{name}'>T</h2><p>{LONG}</p><section id='{name}'><p id='{name}'>One.</p></section>"
    assert html_text.main_text(f"{page}<div class='{name}'>{LONG}</div></article>") == f"T {LONG} One. {LONG}"
    assert html_text.main_text(f"<div><h3 id='{name}'>T</h3><p id='{name}'>{LONG}</p></div>") == f"T {LONG}"


@pytest.mark.parametrize("box", [
    "<div class='related'><a href=1>One more</a> and <a href=2>another</a></div>", "<div class='feedback'>Was it of use?</div>",
    "<div class='comments'><p>{0}</p></div>", "<section id='post-comments'><p>{0}</p></section>", "<div class='ad-box'>{0}</div>",
    "<div id='share-buttons'>{0}</div>", "<p class='ad'>{0}</p>", "<section id='related'><a href=1>{0}</a></section>",
])
def test_boxes_inside_articles(box):
    assert html_text.main_text(f"<article><p>{LONG}</p>{box.format(LONG)}</article>") == LONG


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "word" + "</div>" * 20_000
    assert html_text.main_text(deep) == "word"
    words = "word, " * 200_000
    assert html_text.main_text(f"<article><p>{words}</p></article>") == words.strip()


def article(page):
    """The article of the given pages, which are all made alike."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    plain = re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|h1|br)\b", m.group()) else "", inner)
    return " ".join(html.unescape(plain).split())


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    expected = [(r.page_id, r.url, article(r.html), len(article(r.html))) for r in pages]
    assert ordered(QUERIES["op8_html_extraction"](spark, sf_dir).collect()) == ordered(expected)


def test_columns(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "old"), (None, None, "old")], "page_id long, html string, text string")
    found = html_text.extract_text(df)
    assert found.columns == ["page_id", "html", "text"]
    assert [r.text for r in found.collect()] == ["a", ""]
    assert html_text.extract_text(df.limit(0)).count() == 0
