"""Class and id words that close elements."""

from __future__ import annotations

import pytest

from txnsift.llm import htmltext


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<main class='has-sidebar'><p>the story</p></main>", "the story"),
        ("<article class='post comments-open'><p>the story</p></article>", "the story"),
        ("<div class='content no-sidebar'>x<article><p>the story</p></article></div>", "the story"),
        ("<div id='social-history'><main><p>the story</p></main></div>", "the story"),
        ("<article><p>the story</p><article class='comment'>no</article></article>", "the story"),
        ("<main><p>the story</p><div class='related'><article>teaser</article></div></main>", "the story"),
        ("<div class='related'><article>teaser</article></div><article>the story</article>", "the story"),
        ("<div class='related'><article>teaser</article></div><p>the whole story</p>", "the whole story"),
        ("<aside><article>teaser</article></aside><p>the story</p>", "the story"),
        ("<div class='no-sidebar'><article hidden>x</article></div><p>the story</p>", "the story"),
        ("<div class='no-sidebar'><article>the story<div class='share'>x</div></article></div>", "the story"),
    ],
)
def test_words_do_not_close_the_article(page, text):
    assert htmltext.main_text(page, None, frozenset(), {}) == text
