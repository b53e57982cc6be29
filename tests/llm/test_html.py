from __future__ import annotations

import html
import re

import pytest

from quireflow.llm import html_text
from quireflow.llm.queries import QUERIES

TREE = html_text.train()

PAGE = """<html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home</a><h2>Site</h2></header>
<div class="cookie-notice">We use cookies on this site to make it good</div><div id="main-content"><article><header><h1>Title &amp; more</h1></header>
<p>First par &nbsp; with <a href=x>a link</a> in<b>side</b>.<p>Second<br>line <span class="ad">BUY NOW</span> tail</p><aside class=related>Rel</aside>
<script>if (a < b) { "</p>" }</script><!-- gone <p>x</p> --><form><label>Mail</label><textarea>t</textarea></form><ul><li>one<li>two</ul><p>5 &lt; 6 < 7</p></article>
<section id="comments"><article class="comment"><p>Nice post I really liked reading it very much indeed</p></article></section></div>
<div class=sidebar><p>Some long text in the sidebar that is not content at all really</p></div><footer>&copy; me</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE, TREE).split("\n") == ["Title & more", "First par with a link inside.", "Second line tail", "one", "two", "5 < 6 < 7"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   ", ""),
        ("<article><p>a</p><script>x</script ><p>b", "a\nb"),
        ("<!-- never closed <article><p>x</p></article>", ""),
        ("<nav><p>m</nav><article><p>A</p><p class=ad>no</p><p>B</p></article>", "A\nB"),
        ("<main>\n <div><p>t1</p>tail <i>of</i> it</div></main>", "t1\ntail of it"),
        ("<article><p title='a > b' data-x=\"<p>\">q</p></article>", "q"),
        ("<ARTICLE><P>Upper &eacute; &#233; &#xe9; &unknown;</P></ARTICLE>", "Upper é é é &unknown;"),
        ("<article>" + "<p>w</p>" * 2000 + "</article>", "\n".join("w" * 2000)),
    ],
)
def test_cases(page, text):
    assert html_text.main_text(page, TREE) == text


def test_without_an_article_long_blocks_count():
    prose = "Plain words that go on for a while so that nobody takes them for a menu. " * 4
    links = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(9))
    page = f"<body><ul>{links}</ul><div><p>{prose}</p><p>{prose}</p></div><div class=footer><p>{prose}</p></div></body>"
    assert html_text.main_text(page, TREE) == "\n".join([prose.strip()] * 2)


PROSE = "Plain words that go on for a while so that nobody takes them for a menu, in one sentence or more. " * 3


@pytest.mark.parametrize("kind", ["side-effects", "legal-history", "note-form", "social-contract-theory", "footnote-text", "banner-of-the-king", "menuet"])
def test_names_that_only_sound_like_furniture(kind):
    page = f"<body><nav><a href=/>Home</a></nav><article><p>{PROSE}</p><section class='{kind}' id='{kind}'><h2>Head</h2><p>{PROSE}</p></section></article></body>"
    assert html_text.main_text(page, TREE) == "\n".join([PROSE.strip(), "Head", PROSE.strip()])


@pytest.mark.parametrize("kind", ["site-footer", "cookie-banner", "ad-slot", "related-posts", "share-buttons", "newsletter-signup", "comment-list", "user-comments", "sidebar-left", "SocialLinks"])
def test_names_of_furniture(kind):
    page = f"<body><article><p>{PROSE}</p><div class='{kind}'><p>{PROSE}</p></div></article></body>"
    assert html_text.main_text(page, TREE) == PROSE.strip()


def test_pages_that_name_nothing_are_told_by_words_and_links():
    menu = "".join(f"<div><a href=/{k}>Item {k}</a></div>" for k in range(8))
    page = f"<body><div>{menu}</div><div>Where to go</div><div>{menu}</div><div>A short heading</div><div>{PROSE}</div><div>And then?</div><div>{PROSE} <a href=x>see more</a></div><div>{menu}</div><div><a href=/a>About us all</a> | <a href=/b>Write to us now</a></div></body>"
    assert html_text.main_text(page, TREE).split("\n") == ["A short heading", PROSE.strip(), "And then?", f"{PROSE}see more".replace("  ", " ")]


@pytest.mark.parametrize("block", ["<h2><a href=/x>Early life</a></h2>", "<p><a href=/x>Smith 1990</a></p>", "<ul><li><a href=/x>Paris</a></li><li><a href=/y>Rome</a></li></ul>"])
def test_short_linked_blocks_of_an_article_stay(block):
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{PROSE}</p>{block}<p>{PROSE}</p>{block}</article><footer><a href=/a>About</a></footer></body>"
    own = [x for x in re.sub(r"<[^>]*>", "\n", block).split("\n") if x]
    assert html_text.main_text(page, TREE).split("\n") == ["Head", PROSE.strip(), *own, PROSE.strip(), *own]


def test_long_blocks_with_links_stay_in_an_article_and_go_beside_it():
    linked = f"{PROSE}see <a href=/y>the first of them</a> and <a href=/z>the second one</a>"
    cite = "<p><a href=/x>Smith 1990</a></p>"
    page = f"<body><article><h1>Head</h1><p>{linked}</p>{cite}</article><div><p>{PROSE}</p><p><a href=/u>Ann</a></p></div></body>"
    assert html_text.main_text(page, TREE).split("\n") == ["Head", re.sub(r"<[^>]*>", "", linked), "Smith 1990"]


def test_furniture_in_an_article_goes_whatever_follows():
    page = f"<body><article><p>{PROSE}</p><div class=related-posts><p>{PROSE}</p></div><p><a href=/x>Smith 1990</a></p></article></body>"
    assert html_text.main_text(page, TREE).split("\n") == [PROSE.strip(), "Smith 1990"]


def test_tree_fits_its_table():
    import numpy as np

    rows = np.array([line.split() for line in html_text.LABELLED.strip().splitlines()], float)
    assert (html_text.answers(TREE, rows[:, :-1]) == rows[:, -1]).mean() > 0.95


def test_pages(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["page_id"]: r for r in QUERIES["op5_html_extraction"](spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*?)</article>", p["html"], re.DOTALL)[1], flags=re.DOTALL)
        lines = re.split(r"</?(?:p|h1|div|ul|li)[^>]*>", re.sub(r"<br>", " ", article))
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", y)).split()) for y in lines) if x)
        assert rows[p["page_id"]]["text"] == want and rows[p["page_id"]]["n_chars"] == len(want) and rows[p["page_id"]]["url"] == p["url"]


def test_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<article>a</article>", "y")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "a", 1)], key=str)
    assert html_text.extract(df.limit(0)).collect() == []
