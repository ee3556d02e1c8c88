"""Hidden text within lines, names inside articles, and pages whose article is a division."""

from __future__ import annotations

import pytest

from tidewire.llm import html_text

LINE = "This is a long sentence of the article, with words and a point."
CASES = [
    ('<article><p>Hi <span style="display:none">X</span> you are here.</p></article>', "Hi you are here."),
    ("<article><p>Hi <span hidden>X</span> you are here.</p></article>", "Hi you are here."),
    ("<p>Some words <svg><text>X</text></svg> in the paragraph here, they are many.</p>", "Some words in the paragraph here, they are many."),
    ('<article><p>Buy now <span class="ad">X</span> or later, as you like.</p></article>', "Buy now or later, as you like."),
    (f'<article><p>{LINE}</p><section class="related-work"><p>{LINE} A</p></section></article>', f"{LINE}\n{LINE} A"),
    (f'<article><p>{LINE}</p><p class="notice">{LINE} B</p></article>', f"{LINE}\n{LINE} B"),
    (f'<article><p>{LINE}</p><div class="share-price">{LINE} C</div></article>', f"{LINE}\n{LINE} C"),
    (f'<article><p>{LINE}</p><div class="share-buttons">{LINE} X</div><div class="ad-slot">{LINE}</div><aside>{LINE}</aside></article>', LINE),
    (f'<div class="post-content"><p>{LINE}</p><ul><li>one two</li><li>three</li></ul><blockquote>{LINE} Q</blockquote><pre>code x</pre></div><div class="sidebar">X {LINE}</div><div><a href="/">X home</a></div>', f"{LINE}\none two\nthree\n{LINE} Q\ncode x"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_pages(page, want):
    assert html_text.main_text(page, html_text.train([])) == want
