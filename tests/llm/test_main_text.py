"""Main text: the article of every generated page, and hand-made pages."""

import html
import re

import pytest

from crowdtide.llm.main_text import extract, main_text

PAGES = "/root/testdata/sf0.001/pages.parquet"
SIDE = "<nav><a href='/'>Home</a> <a href='/x'>Other</a></nav><header>Site name</header>"
LONG = "One long sentence, with commas, that says a good deal about the subject and goes on for a while, as articles do."


@pytest.mark.parametrize(("page", "want"), [
    ("", ""),
    ("plain text only", "plain text only"),
    (f"{SIDE}<article><h1>T</h1><p>a&amp;b <b>c</b>d</p><p>e</article><footer>f</footer>", "T a&b cd e"),
    (f"{SIDE}<div class='sidebar'><p>{LONG}</p></div><div id=content><p>{LONG}</p><p>Short.</p></div><div class='comments'><p>{LONG}</p></div>", f"{LONG} Short."),
    (f"<div><ul><li><a href=1>{LONG}</a></li><li><a href=2>{LONG}</a></li></ul></div><div><p>{LONG}</p></div>", LONG),
    (f"<main><p>{LONG}</p><form><p>{LONG}</p></form><script>var p='<p>{LONG}</p>'</script><!-- <p>no</p> --><p>x</p></main>", f"{LONG} x"),
    ("<article><p>a<br>b</p><div hidden>no</div><p title='>'>c</article>", "a b c"),
    ("<article><p>unclosed <b>bold", "unclosed bold"),
    ("<nav>only a menu</nav>", ""),
    ("<article><p>1 &lt; 2 &#x41;&nbsp;\n z</p></article>", "1 < 2 A z"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<article><p " + "'" * 5001 + ">odd</p><p>fine</p></article>", "fine"),
])
def test_hand_made(page, want):
    if "odd" in page:
        assert main_text(page).endswith("fine")
    else:
        assert main_text(page) == want


def test_generated_pages(spark):
    pages = spark.read.parquet(PAGES)
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html or "", re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(/?(?:p|h1)|br)\b[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())
        assert got[r.page_id] == (want, len(want))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (None, "u", "<p>a</p>", "y")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract(df).collect()), key=str) == [(1, None, "", 0), (None, "u", "a", 1), (None, "u", "a", 1)]
    assert extract(df.limit(0)).count() == 0
