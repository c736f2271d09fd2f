"""The span index against plain rescanning: the same elements in one pass, whatever the markup."""

import random
import re
import time

import pytest

from webloom.kernel import page, tags
from webloom.kernel.text import BLANK, trim, utf16_len


def tag_at(html, m):
    rest = tags._REST.match(html, m.end())
    return None if rest is None else tags.Tag(re.sub(rf"/[{BLANK}]*\Z", "", rest[1]), m.start(), rest.end(), rest[1].endswith("/"))


def rescanned(html, name):
    """Outermost elements: from each opener on, openers and closers are counted up to its own."""
    opener = re.compile(rf"<{name}(?![A-Za-z0-9_])", re.I | re.A)
    either = re.compile(rf"<(?:(/[{BLANK}]*{name}[{BLANK}]*>)|{name}(?![A-Za-z0-9_]))", re.I | re.A)
    at = 0
    while (m := opener.search(html, at)) and (tag := tag_at(html, m)):
        if tag.self_closing:
            yield tag, ""
            at = tag.content
            continue
        depth, at = 1, tag.content
        while depth:
            m = either.search(html, at)
            if m is None:
                return
            if m[1]:
                depth, at = depth - 1, m.end()
            else:
                inner = tag_at(html, m)
                depth += inner is not None and not inner.self_closing
                at = m.end() if inner is None else inner.content
        yield tag, html[tag.content : m.start()]


def plain_main_content(html):
    for name in ("article", "main"):
        best = None
        for _, inside in rescanned(html, name):
            inside = trim(inside)
            if utf16_len(inside) > 200 and (best is None or utf16_len(inside) > utf16_len(best)):
                best = inside
        if best is not None:
            return name, best
    for how, fits in (("itemprop", page._ITEMPROP), ("class", page._CMS)):
        best = None
        for name in page.CONTAINERS:
            for tag in tags.find_tags(html, name):
                if fits.search(tag.attributes):
                    inside = next((c for _, c in rescanned(html[tag.start :], name)), "")
                    if inside and (best is None or utf16_len(inside) > utf16_len(best)):
                        best = inside
        if best is not None and utf16_len(best) > 200:
            return how, best
    body = next((c for _, c in rescanned(html, "body")), "")
    return ("body", body) if body else ("document", html)


PIECES = [
    "<div>", "</div>", "</ div\n>", "<DIV class='entry-content'>", '<div class="x story-body y">', "<div/>", "<div class=a/>", "<section itemprop = 'articleBody'>", "</section>", "<article>", "</article>", "<main id=1>", "</main>",
    "<body>", "</body>", "<p>", '<div title="<div>">', "<div title='</div>'>", '<section a="<article>">', "<div '", '<article "', "</div", "<divx>", "text ", "x" * 60, "😀" * 55, " \n", "<", ">", '"', "<!-- <div> -->",
]


@pytest.mark.parametrize("seed", range(40))
def test_random_markup(seed):
    r = random.Random(seed)
    for _ in range(60):
        pieces = r.sample(PIECES, r.randint(3, len(PIECES)))
        html = "".join(r.choice(pieces) for _ in range(r.randint(0, 40)))
        for name in ("div", "section", "article", "body"):
            assert list(tags.balanced_contents(html, name)) == list(rescanned(html, name)), html
        assert page.main_content(html) == plain_main_content(html), html


def test_names_do_not_see_each_other():
    found = tags.spans('<section a="<div>"><div b="</section>">x</div></section>', ("section", "div"))
    assert [s.text for s in found["section"]] == ['<div b="']
    assert [s.text if s.end else None for s in found["div"]] == [None, "x"]


def test_several_articles():
    """The longest of several, the first of equal ones; short ones and decoys give way."""
    long, longer = "a" * 250, "b" * 300
    assert page.main_content(f"<article>{long}</article><article>{longer}</article>") == ("article", longer)
    assert page.main_content(f"<article>{'c' * 250}</article><article>{long}</article>")[1] == "c" * 250
    assert page.main_content(f"<article>short</article><main>{long}</main>") == ("main", long)
    assert page.main_content(f"<article>x<article>{long}</article>y</article>")[1] == f"x<article>{long}</article>y"
    assert page.main_content(f"<article>{'😀' * 101}</article>")[0] == "article"
    assert page.main_content(f'<div class="entry-content"><div class="entry-content">{long}</div></div>')[1].startswith("<div")


@pytest.mark.parametrize(
    "html",
    [
        '<div class="entry-content">' * 20_000 + "x" + "</div>" * 20_000,
        '<div class="entry-content">x' * 20_000,
        '<div itemprop="articleBody">😀' * 20_000 + "</div>" * 10_000,
        "<article>" * 20_000 + "</article>" * 19_999,
        "<div class='post-content' <div " * 20_000,
    ],
)
def test_linear(html):
    began = time.perf_counter()
    page.main_content(html)
    assert time.perf_counter() - began < 1


def test_links_without_ends_are_linear():
    began = time.perf_counter()
    assert len(page.extract_links("<a href=/x>y" * 20_000, "https://a.example/")) == 20_000
    assert time.perf_counter() - began < 3


@pytest.mark.parametrize(
    ("html", "n"),
    [
        ('<div class="entry-content">' * 20_000 + "x" * 300 + "</div>" * 20_000, 300),
        ("<b>" * 3000 + "x" * 300, 12_300),
        ("<ol>" + "<li> <b>x </b> y</li>" * 5000 + "</ol>", None),
        ("<p><i>a<b>b</i>c</b>" * 5000, None),
    ],
)
def test_articles_of_deep_and_wide_pages(html, n):
    """Tree and markdown too: no call is refused, and nothing is looked through again for each element."""
    began = time.perf_counter()
    found = page.read_article(html, "https://a.example/")
    assert time.perf_counter() - began < 5 and (n is None or len(found["markdown"]) == n)


def test_too_deep():
    with pytest.raises(ValueError):
        page.read_article("<div>" * 60_000 + "x", "https://a.example/")
