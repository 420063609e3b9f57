import html as reference
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from recordgauge.llm import page_blocks as b

PROSE = "It was the best of times and it was the worst of times for all who had been there with them in the city."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>", ""), (f"<p>{PROSE}", PROSE),
        (f"<article><h1>A &amp; B</h1><p>One<br>two&nbsp; three<p>{PROSE}</article><footer>f</footer>", f"A & B\nOne two three\n{PROSE}"),
        (f"<nav><a href=x>{PROSE}</a></nav><div>{PROSE}</div>", PROSE),
        (f"<main><p>Short.</p><aside>{PROSE}</aside><form>{PROSE}<input></form></main>", "Short."),
        (f'<article><p>{PROSE}</p><div class="user-comments"><p>{PROSE}</p></div></article>', PROSE),
        (f'<div id="cookieNotice">{PROSE}</div><div role="banner">{PROSE}</div><h2>Title</h2><p>{PROSE}</p>', f"Title\n{PROSE}"),
        (f"<script>if (a < b) '<p>{PROSE}'</script><style>p {{}}</style><!-- <p>{PROSE} --><p>{PROSE}</p>", PROSE),
        (f"<p>{PROSE}</p><ul><li><a href=a>one link</a></li><li><a href=b>another</a></li></ul>", PROSE),
        (f"<p>{PROSE}</p><p>Between.</p><p>{PROSE}</p>", f"{PROSE}\nBetween.\n{PROSE}"),
        (f"<header><h1>Site</h1></header><article><header><h1>Own title</h1></header><p>{PROSE}</p></article>", f"Own title\n{PROSE}"),
        (f"<article><p>5 < 6 & x &lt;b&gt; <b class='x>y'>bold</b> <i>it</i>alic {PROSE}</p></article>", f"5 < 6 & x <b> bold italic {PROSE}"),
        (f"<ARTICLE><P>{PROSE}</P></ARTICLE", PROSE), (f'<article><p title="unclosed>{PROSE}</p></article>', PROSE),
        (f"<p hidden>{PROSE}</p><p style='display: none'>{PROSE}</p><p>{PROSE}</p>", PROSE),
        (f"<article><div>a</span></div></section><p>{PROSE}</p></article>", f"a\n{PROSE}"),
    ],
)
def test_pages(page, text):
    assert b.main_text(page) == text


def test_an_article_of_any_text_is_kept_whole():
    lines = ["###$$$ %%%", "Und Und Und " * 100, "x | y | z", "..."]
    page = "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article><div>Read more</div>"
    assert b.main_text(page) == "\n".join(" ".join(x.split()) for x in lines)


def test_long_and_hostile_pages_end():
    for page in ("<" * 50_000, "<p " * 20_000, "<div>" * 5_000 + PROSE, '<a b="' * 5_000, "&amp" * 50_000, "<!--" * 20_000, "<script>" * 5_000):
        assert isinstance(b.main_text(page), str)
    assert b.main_text(f"<article><p>{PROSE * 2_000}</p></article>") == PROSE * 2_000


def test_second_pass_takes_the_nearest():
    def block(label, heading=False):
        return b.Block("x", 0, False, False, 0, heading, label)

    row = [block(True), block(None), block(None), block(None), block(False), block(None)]
    b.second_pass(row)
    assert [x.label for x in row] == [True, True, True, False, False, False]
    row = [block(True), block(None, True), block(False)]
    b.second_pass(row)
    assert row[1].label is False


def test_frames(spark):
    rows = [(1, "u", f"<p>{PROSE}</p>"), (1, "u", f"<p>{PROSE}</p>"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("N_Chars", F.lit("x"))
    got = b.extract(pages).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, PROSE, len(PROSE))] * 2 + [(None, "", 0)]
    assert b.extract(pages.limit(0)).count() == 0


def test_query_gives_the_articles(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    from recordgauge.llm.queries import queries

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries()["op7_page_blocks"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        lines = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1)>", "\n", article)).split("\n")
        expected = [" ".join(reference.unescape(x).split()) for x in lines]
        assert r.text == "\n".join(x for x in expected if x) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content has-sidebar'>{}</div>", "<div id='page' class='no-sidebar'>{}</div>", "<div class='search-result'>{}</div>",
        "<article class='post with-comments'>{}</article>", "<div class='widget'>{}</div>", "<div class='layout sidebar-right'>{}<div class=sidebar>x</div></div>",
        "<div class='elementor-widget'>{}</div><div class='elementor-widget'></div>", "<div class='related'>{}</div><p>Short.",
    ],
)
def test_names_of_containers_do_not_cut_the_text(page):
    text = f"<p>{PROSE}</p><p>{PROSE}</p>"
    assert b.main_text(page.format(text)).startswith(f"{PROSE}\n{PROSE}")


def test_an_entry_header_is_the_headline():
    head = "<div class='entry-header'><h1>Title</h1></div>"
    assert b.main_text(f"<article>{head}<p>{PROSE}</p></article>") == f"Title\n{PROSE}"
    assert b.main_text(f"<div>{head}<p>{PROSE}</p></div>") == f"Title\n{PROSE}"


@pytest.mark.parametrize("name", ["comments-area", "sidebar", "ad-slot", "site-footer", "shareButtons", "related-posts", "newsletter-signup", "user_comments", "cookie-banner"])
def test_names_of_parts_beside_the_text_cut(name):
    other = f"<div class='{name}'><p>{PROSE} Other.</p></div>"
    assert b.main_text(f"<p>{PROSE}</p><p>{PROSE}</p>{other}") == f"{PROSE}\n{PROSE}"


def test_comments_longer_than_the_text_are_cut():
    assert b.main_text(f"<p>{PROSE}</p><div class=comments>" + f"<p>{PROSE}</p>" * 9 + "</div>") == PROSE


FOREIGN = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p>{PROSE}</p><table><tr><td>Year</td><td>1999</td></tr><tr><td>Price</td><td>12</td></tr></table>", f"{PROSE}\nYear\n1999\nPrice\n12"),
        (f"<section><p>{PROSE}</p></section><section><h2>Hours</h2><p>Nine to five.</p></section>", f"{PROSE}\nHours\nNine to five."),
        (f"<nav><a href=a>x</a></nav><h1>Otsikko</h1><p>{FOREIGN}</p><p>Lyhyt.</p><ul><li><a href=a>linkki</a></ul>", f"Otsikko\n{FOREIGN}\nLyhyt."),
        ("<table>" + "<tr><td>Name of it</td><td>123456</td></tr>" * 9 + "</table><footer>f</footer>", "\n".join(["Name of it", "123456"] * 9)),
        (f"<section><p>{PROSE}</p><section><p>In.</p></section></section><section><p><a href=a>link</a></p><section><p>Out.</p></section></section>", f"{PROSE}\nIn."),
    ],
)
def test_open_blocks_ask_the_parts_around_theirs(page, text):
    assert b.main_text(page) == text


def test_parts_without_end():
    assert b.main_text("<section>" * 5_000 + PROSE + "<section>Short." * 5_000).startswith(f"{PROSE}\nShort.")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<h1>Title</h1><p>Closed until Monday.</p>", "Title\nClosed until Monday."),
        (f"<article><p>{PROSE}</p><ul><li><a href=x>See the manual</a></li></ul><p>{PROSE}</p></article>", f"{PROSE}\nSee the manual\n{PROSE}"),
        (f"<article><p><a href=x>{PROSE}</a></p></article>", PROSE),
        (f"<form action=x><h1>Title</h1><p>{PROSE}</p></form>", f"Title\n{PROSE}"),
        (f"<form action=x><p>Search</p></form><p>{PROSE}</p>", PROSE),
        (f"<nav><ul><li><a href=1>Home</a></li></ul><div><p>{PROSE}</p></div>", PROSE),
        (f"<article><p>{PROSE}</p><p class=notice>{PROSE} and more</p></article>", PROSE),
        (f"<div class=post><p>{PROSE}</p></div><div class=related-posts><p>{PROSE}</p><p>{PROSE}</p></div>", PROSE),
        ("<div class=box>" * 5 + "<div class=comments>" * 20 + f"<p>{PROSE}</p>" + "</div>" * 25 + f"<p>{PROSE} x</p>", f"{PROSE} x"),
    ],
)
def test_names_forms_and_short_pages_by_evidence(page, text):
    assert b.main_text(page) == text


@pytest.mark.parametrize(
    "page", ["<div>" * 20_000 + "x" + "</div></nav></p>" * 20_000, "<div class='ad'><p>x</p>" * 20_000, "<p><div></section>" * 20_000]
)
def test_nesting_is_read_in_linear_time(page):
    begun = time.process_time()
    b.main_text(page)
    assert time.process_time() - begun < 5
