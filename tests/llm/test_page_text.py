import html
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hindsight.llm import page_text as p
from hindsight.llm.queries import op13_html_extraction

LONG = "A sentence of the article that goes on for a while, as sentences of articles do, without any link."


def test_given_pages_have_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {r.page_id: r for r in op13_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == len(pages)
    for page in pages:
        article = re.search("<article>(.*)</article>", page.html, re.DOTALL)[1]
        blocks = re.sub(r"</?(p|h1|br)>", " ", article.replace("<b>", "").replace("</b>", ""))
        expected = " ".join(html.unescape(blocks).split())
        assert tuple(found[page.page_id]) == (page.page_id, page.url, expected, len(expected))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   \n", ""),
        ("no markup at  all", "no markup at all"),
        ("<p>one<p>two</p>", "one two"),
        (f"<p>{LONG}<p>in<b>side</b> a&nbsp;\n block &amp;amp; &eacute;&#233;&#xD800;", f"{LONG} inside a block &amp; éé�"),
        (f"<body><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul><p>{LONG}</p><p>Short.</p></body>", f"{LONG} Short."),
        (f"<div>Menu</div><div><h2>Title</h2><p>{LONG}</p><p>No.</p><p>{LONG}</p></div><div>Imprint</div>", f"Title {LONG} No. {LONG}"),
        (f"<article><header><h1>Title</h1><p>By me</p></header><p>{LONG}</p><footer>Filed</footer></article>", f"Title {LONG}"),
        (f"<div class='page has-sidebar'><div class=siteHeader>Site</div><p>{LONG}</p><div id=side-bar class='sidebar left'>{LONG}</div></div>", LONG),
        (f"<main><p>{LONG}</p></main><section id=comments><article class=comment><p>{LONG} {LONG}</p></article></section>", LONG),
        (f"<article><p>{LONG}</p><div class='cookie-notice'>{LONG}</div><form>Name <input> <button>Go</button></form></article>", LONG),
        (f"<aside>{LONG}</aside><nav>{LONG}</nav><p>{LONG}</p><div role=contentinfo>{LONG}</div><div hidden>{LONG}</div>", LONG),
        (f"<script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p {{}}</style><!-- <p>{LONG}</p> --><p>{LONG}", LONG),
        (f"<article><p>See <a href=/>all of this</a> and {LONG}</p><p><a href=/>A paragraph that is a link</a></p></article>", f"See all of this and {LONG} A paragraph that is a link"),
        (f"<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl><p>{LONG}</article>", f"a b c d e {LONG}"),
        (f"<p>{LONG}</p><p title='unclosed", LONG),
        (f"<![CDATA[ x ]]><![if IE]><p>{LONG}</p></div></b><![endif", LONG),
        (f"<p>{LONG}</p><!-- cut <p>{LONG}", LONG),
        (f"<p>{LONG} 1 < 2 &amp", f"{LONG} 1 < 2 &"),
        (f"<article><p>{LONG}<article><p>{LONG}", f"{LONG} {LONG}"),
    ],
)
def test_pages(page, text):
    assert p.page_text(page) == text


def test_whole_texts():
    parts = [f"Paragraph {i}. " + "word " * (i % 50) for i in range(20_000)]
    page = "<body><nav>menu</nav><article>" + "".join(f"<p>{part}</p>" for part in parts) + "</article></body>"
    assert p.page_text(page) == " ".join(" ".join(parts).split())


def test_deep_and_wide_pages_take_linear_time():
    deep = "<div>" * 50_000 + LONG + "</span>" * 50_000 + "</div>" * 50_000
    assert p.page_text(deep) == LONG
    assert p.page_text("<b>" * 20_000 + "<li>x<td>y" * 5_000).startswith("x y x")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<a href=x>", "</a>", "text", " ", "&amp", "&#", "<!--", "-->", "<!", "<![x[", "]]>", "<?", "</", "<", ">", "<script>", "</script>", "<article>", "</article>", "<br/>", "<header>", "<h1>", "'", '"', "\x00"]), max_size=30))
def test_any_markup(parts):
    text = p.page_text("".join(parts))
    assert text == " ".join(text.split())


def test_smoothing_and_clusters():
    values = np.array([0.0, 0, 10, 0, 0])
    kernel = np.exp(-0.5 * (np.arange(-4, 5) / p.SIGMA) ** 2)
    brute = [sum(kernel[4 + j - i] * values[j] for j in range(5)) / sum(kernel[4 + j - i] for j in range(5)) for i in range(5)]
    assert np.allclose(p.smoothed(values), brute)
    assert p.upper_cluster(np.array([1.0, 2, 1, 50, 60, 55])).tolist() == [False] * 3 + [True] * 3
    assert p.upper_cluster(np.array([3.0, 3.0])).all()
    assert p.upper_cluster(np.array([7.0])).all()


def test_lines_count_tags_and_links():
    events = p.Events()
    events.feed("<ul><li><a href=/>one</a></li></ul><p>two <i>three</i></p>")
    events.close()
    assert isinstance(events, HTMLParser)
    assert [(line.text, line.tags, line.is_link()) for line in events.lines] == [("one", 5, True), ("two three", 5, False)]


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "y"), (None, "u", f"<p>{LONG}", "x", "y"), (1, "u", "", "x", "y"), (1, "u", "", "x", "y")]
    found = p.main_text(spark.createDataFrame(rows, schema))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(
        map(str, [(1, None, "", 0), (None, "u", LONG, len(LONG)), (1, "u", "", 0), (1, "u", "", 0)])
    )
    assert p.main_text(spark.createDataFrame([], schema)).collect() == []
