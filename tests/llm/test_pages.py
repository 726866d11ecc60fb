"""Main text of pages with and without articles, wrappers, short lines and broken markup."""

from __future__ import annotations

import time

import pytest

from millrace.llm.htmltext import main_text, names_boilerplate

LONG = "A long line of text that goes on for a while. " * 8
BODY = LONG.strip()


@pytest.mark.parametrize("name", ["no-sidebar", "with-sidebar", "has-sidebar", "theory-related", "menu"])
@pytest.mark.parametrize("tag", ["article", "section"])
def test_wrappers_do_not_matter(name, tag):
    """A name on a block around the region is not looked at; only whole names are boilerplate."""
    page = f'<body class="home"><div class="{name}"><{tag}><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></{tag}></div></body>'
    if name != "menu" or tag == "article":
        assert main_text(page) == f"T\n{BODY}\n{BODY}\nEnd."


def test_names():
    for token in "sidebar ad ads cookie-notice site-footer post-comments related-posts share_buttons nav-bar newsletter-signup Social-Links comment-list".split():
        assert names_boilerplate(token), token
    for token in "no-sidebar with-sidebar social-history theory-related adorn shared header-image research commentary story content".split():
        assert not names_boilerplate(token), token


def test_named_paragraph_inside_an_article_is_text():
    assert main_text(f'<article><p class="social-history">{LONG}</p><p>{LONG}</p><div class="related-posts"><p>{LONG}</p></div></article>') == f"{BODY}\n{BODY}"


@pytest.mark.parametrize(("before", "after"), [("", ""), ("<div id=c>", "</div>"), ("<main>", "</main>"), ("<div class=page><div>", "</div></div>")])
def test_short_lines_stay(before, after):
    page = f"<html><body><nav>a b</nav>{before}<h1>Title</h1><p>By A</p><p>1 May</p><p>Rome</p>" + f"<p>{LONG}</p>" * 4
    page += f"<p>one.</p><p>two.</p><p>three.</p>{after}<footer>x</footer></body></html>"
    assert main_text(page).split("\n") == ["Title", "By A", "1 May", "Rome", *[BODY] * 4, "one.", "two.", "three."]


def test_title_above_the_block_of_text():
    page = f"<div id=h>Home | About</div><div><h1>Title</h1><p>By A</p><div class=body>{f'<p>{LONG}</p>' * 3}</div></div><div>Contact us</div>"
    assert main_text(page).split("\n") == ["Title", "By A", *[BODY] * 3]
    page = f"<h2>Title</h2><p>By A</p><div class=body>{f'<p>{LONG}</p>' * 3}</div><div class=footer>f</div>"
    assert main_text(page).split("\n") == ["Title", "By A", *[BODY] * 3]


def test_hidden_elements_do_not_divide_a_line():
    page = f"<article><p>before <button>Click</button> middle <svg><text>no</text></svg><script>x('<p>')</script> <select><option>o</option></select> after {LONG}</p><p>{LONG}</p></article>"
    assert main_text(page) == f"before middle after {BODY}\n{BODY}"


def test_several_articles():
    pair = f"<article><p>{LONG}</p></article><article><h2>B</h2><p>{LONG * 5}</p></article>"
    for around in ("<body>{}<div>junk</div></body>", "<main>{}</main>", "<body><div>{}</div></body>"):
        assert main_text(around.format(pair)).split("\n") == [BODY, "B", (LONG * 5).strip()]


def test_outside_the_article():
    page = f"<div class=top-bar>x</div><article><header><h1>T</h1></header><p>{LONG}</p><footer>tags</footer></article><section id=comments><p>{LONG * 3}</p></section>"
    assert main_text(page) == f"T\n{BODY}"


def test_time_grows_with_the_page():
    for page in ("<b>" * 100_000 + LONG + "</i>" * 100_000, "<div>" * 60_000 + LONG + "</span>" * 60_000, f"<p>{LONG}" * 5_000):
        start = time.perf_counter()
        assert BODY in main_text(page)
        assert time.perf_counter() - start < 5
    text = main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")
    assert text == "\n".join([BODY] * 20_000)
