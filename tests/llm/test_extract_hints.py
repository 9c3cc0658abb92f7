"""Comments, notices and adverts stay out however long they are; deep pages are linear."""

from __future__ import annotations

import time

import pytest

from tallyline.llm.extract import _around, main_text

POST = "The first sentence of the article is here. A second sentence follows it. The third one ends the short post."
LONG = " ".join(f"Reader number {i} says something long and dense about all of this." for i in range(24))


@pytest.mark.parametrize("page", [
    f'<div class="post"><p>{POST}</p></div><div class="comments"><p>{LONG}</p></div>',
    f'<div class="post"><p>{POST}</p></div><section id="comments"><p>{LONG}</p></section>',
    f'<article><p>{POST}</p><div class="comments"><p>{LONG}</p></div></article>',
    f'<div class="cookie-notice"><p>{LONG}</p></div><div class="post"><p>{POST}</p></div>',
    f'<div class="gdpr"><p>{LONG}</p></div><main><p>{POST}</p></main>',
    f'<div class="post"><p>{POST}</p></div><div class="advert"><p>{LONG}</p></div>',
    f'<main><p>{POST}</p></main><div id="disqus"><article class="comment"><p>{LONG}</p></article></div>',
])
def test_firm_hints_are_never_undone(page):
    assert main_text(f"<html><body>{page}</body></html>") == POST


@pytest.mark.parametrize("page", [
    f'<article class="post comments-open"><p>{LONG}</p></article>',
    f'<div class="site-content no-sidebar"><p>{LONG}</p></div>',
    f'<div class="layout has-comments"><p>{LONG}</p></div>',
    f'<div class="cookie-consent"><article><p>{LONG}</p></article></div>',
])
def test_layout_hints_do_not_hide_the_page(page):
    assert main_text(f"<html><body>{page}</body></html>") == LONG


def test_deep_pages_are_linear():
    n = 8_000
    deep = "".join(f"<div>line {i} of a deep page</b>" for i in range(n)) + "</div>" * n
    start = time.process_time()
    assert main_text(deep)
    assert time.process_time() - start < 3


@pytest.mark.parametrize("piece", ["<!-- x ", "<!-- x > ", "<a b='", "</a ", "<!x ", "<?x ", "a & b < c "])
def test_markup_that_never_ends_is_linear_and_read_as_far_as_it_goes(piece):
    start = time.process_time()
    whole = main_text(f"<html><body><p>{POST}</p><p>" + piece * 40_000)
    assert time.process_time() - start < 3
    assert whole.startswith(POST)


@pytest.mark.parametrize("tail,text", [
    ("<!-- open", "<!-- open"), ("<!-- a > b", "<!-- a > b"), ("<a href='x", "<a href='x"), ("x &amp", "x &"), ("x &lt;y", "x <y"),
    ("</p", "</p"), ("a < b", "a < b"), ("<script>x = 1", ""), ("<script>x > 1", ""), ("<!-- a --> b <!-- c", "b <!-- c"),
])
def test_a_page_that_breaks_off(tail, text):
    assert main_text(f"<html><body><p>{POST}</p><p>{LONG} {tail}") == f"{POST} {LONG} {text}".rstrip()


def test_around_equals_walking_up():
    """The sums from below against every line walking up its regions."""
    import random

    draw = random.Random(2)
    for _ in range(200):
        above = [0] + [draw.randrange(i) for i in range(1, 12)]
        lines = [(draw.randrange(12), draw.randint(1, 9)) for _ in range(10)]
        chosen = {r for r, _ in lines if draw.random() < 0.4}

        def up(r):
            while r:
                yield r
                r = above[r]

        most = {r for r in range(1, 12) if any(r in up(x) for x, _ in lines)
                and sum(s for x, s in lines if r in up(x) and x in chosen) >= 0.8 * sum(s for x, s in lines if r in up(x))}
        assert _around(chosen, lines, above) == {x for x, _ in lines if any(r in most for r in up(x))}
