"""Pages whose article lies beside or under class words, or holds links and short paragraphs."""

import pytest

from crowdtide.llm.main_text import main_text

from .test_main_text import LONG

ARTICLE = f"<article><h1>T</h1><p>{LONG}</p></article>"
LINKS = "<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul>"


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "content-with-sidebar", "social-policy", "post-comment-open", "sidebar", "page social"])
def test_words_around(name):
    assert main_text(f"<nav>menu</nav><div class='{name}'>{ARTICLE}</div><footer>f</footer>") == f"T {LONG}"
    assert main_text(f"<div id='{name}'><p>{LONG}</p><p>Short.</p></div>") == f"{LONG} Short."


@pytest.mark.parametrize(("page", "want"), [
    (f"<article><p>{LONG}</p><h2>References</h2>{LINKS}</article>", f"{LONG} References First source Second source"),
    (f"<div id=post><p>{LONG}</p><p>{LONG}</p><section>{LINKS}</section></div>", f"{LONG} {LONG} First source Second source"),
    (f"<div id=post><div><p>{LONG}</p><p>{LONG}</p></div><p>The end.</p></div>", f"{LONG} {LONG} The end."),
    (f"{ARTICLE}<div class='comments'><article><p>{LONG}</p><p>{LONG}</p></article></div>", f"T {LONG}"),
    (f"<article><p>Short note.</p></article><div class='related'><p>{LONG}</p></div>", "Short note."),
])
def test_kept(page, want):
    assert main_text(page) == want
