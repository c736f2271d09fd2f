"""Rules of the kernels, case by case."""

import gzip
import re

import pytest

from webloom.kernel import feed, net, page, robots, sitemap, tags, text, url
from webloom.kernel.markdown import html_to_markdown

LONG = "word " * 60


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<h1>Title</h1><p>Body</p>", "# Title\n\nBody"),
        ("<p>a <strong>b</strong> <em>c</em></p>", "a **b** _c_"),
        ("<ul><li>one</li><li>two</li></ul>", "-   one\n-   two"),
        ("<ol start=3><li>one<li>two</ol>", "3.  one\n4.  two"),
        ('<a href="/x" title="T">link</a>', '[link](/x "T")'),
        ("<pre><code class=language-py>x = 1\n</code></pre>", "```py\nx = 1\n```"),
        ("<p>use <code>a`b</code></p>", "use ``a`b``"),
        ("<script>x</script><style>y</style><nav>n</nav><p>kept</p><svg>s</svg>", "kept"),
        ("<p>1*2_3</p>", "1\\*2\\_3"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n> \n> b"),
        ("a<br>b", "a  \nb"),
        ("<hr>", "* * *"),
        ('<img src="i.png" alt="A">', "![A](i.png)"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<p><b>x</p><p>y</p>", "**x**\n\n**y**"),
        ("<p>  a   b\n c </p>", "a b c"),
        ("", ""),
        ("<!-- no -->yes", "yes"),
        ("<ul><li>a<ul><li>b</li></ul></li></ul>", "-   a\n    -   b"),
    ],
)
def test_markdown(html, wanted):
    assert html_to_markdown(html) == wanted


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<p>a</p><p>b</p>", "a\nb"),
        ("a<script>var x='<p>';</script>b", "ab"),
        ("x&nbsp;&amp;&lt;&copy;", "x &<&copy;"),
        ("a<br/>b", "a\nb"),
        ("<div>a</div>\n\n\n<div>b</div>", "a\n\nb"),
        ("<title>t</title>", "t"),
        ("", ""),
    ],
)
def test_strip(html, wanted):
    assert text.strip_html(html) == wanted


@pytest.mark.parametrize(
    ("s", "wanted"),
    [("&amp;lt;", "<"), ("&#65;&#x42;", "AB"), ("&#X41;", "&#X41;"), ("&nbsp;", " "), ("&LT;", "&LT;"), ("&#39;&apos;", "''")],
)
def test_entities(s, wanted):
    assert text.decode_entities(s) == wanted


def test_entity_out_of_range():
    with pytest.raises(ValueError):
        text.decode_entities("&#1114112;")


def test_display_cap():
    assert text.display_cap("abc", 3) == "abc"
    assert text.display_cap("abcd", 3) == "abc\n\n[... truncated 1 chars ...]"
    assert text.utf16_len("a😀") == 3


@pytest.mark.parametrize(("s", "wanted"), [("0.8x", 0.8), ("  1.5", 1.5), ("x", None), ("1e400", None), (".5", 0.5), ("-2", -2.0)])
def test_number_prefix(s, wanted):
    assert text.number_prefix(s) == wanted


def test_attributes():
    assert tags.parse_attributes(""" A=1 b="x>y" c='&amp;' d e/ a=2""") == {"a": "2", "b": "x>y", "c": "&", "d": "", "e": ""}


def test_tags():
    assert [t.attributes.strip() for t in tags.find_tags('<a x="1>2"><abbr><A/><a-b><a', "a")] == ['x="1>2"', "", "-b"]
    # A closing slash is no part of a value; closers may have blanks; an opener that never ends is passed over.
    assert [tags.parse_attributes(t.attributes) for t in tags.find_tags("<link rel=x href=/a/><link href=/b/ / >", "link")] == [{"rel": "x", "href": "/a"}, {"href": "/b/"}]
    assert [x for _, x in tags.balanced_contents("<article>a</ article ><ARTICLE>b</\tarticle>", "article")] == ["a", "b"]
    assert [x for _, x in tags.balanced_contents("<article>a <article ' b</article>", "article")] == ["a <article ' b"]
    assert page.main_content('<div subclass="entry-content">' + "x" * 300 + "</div>")[0] != "class"
    assert [x for _, x in tags.balanced_contents("<b>1<b/>2<b>3</b>4</b><b/><b>5", "b")] == ["1<b/>2<b>3</b>4", ""]
    assert [c for _, c in tags.balanced_contents("<p>1<p>2</p></p><p/><P>3</p >", "p")] == ["1<p>2</p>", "", "3"]
    assert [c for _, c in tags.balanced_contents("<p>1</p><p>2<p>3</p>", "p")] == ["1"]
    assert tags.first_balanced_where("<p id=a>1</p><p id=b>2</p>", "p", lambda a: a.get("id") == "b") == "2"


@pytest.mark.parametrize(
    ("href", "base", "wanted"),
    [
        ("../a/./b?x=1>2#f", "http://Ex.com:80/p/q/r", "http://ex.com/p/a/b?x=1%3E2#f"),
        ("//x.org", "https://a/b", "https://x.org/"),
        ("?q", "http://a/b/c?d", "http://a/b/c?q"),
        ("#z", "http://a/b?c", "http://a/b?c#z"),
        ("", "http://a/b#c", "http://a/b"),
        ("http://0x7f.1/", None, "http://127.0.0.1/"),
        ("http://2130706433", None, "http://127.0.0.1/"),
        ("http://[0:0::1]/", None, "http://[::1]/"),
        ("http://münchen.de/ä b", None, "http://xn--mnchen-3ya.de/%C3%A4%20b"),
        ("mailto:a@b", None, "mailto:a@b"),
        ("HTTP://user:pa ss@h:8080/%7Ef/../x", None, "http://user:pa%20ss@h:8080/x"),
        ("\\x\\y", "http://a/b", "http://a/x/y"),
        ("http://a\tb/", None, "http://ab/"),
        ("http://256.1.1.1/", None, None),
        ("http://a b/", None, None),
        ("rel", None, None),
        ("http://h:99999/", None, None),
        ("file:///C|/x", None, "file:///C:/x"),
    ],
)
def test_url(href, base, wanted):
    assert url.resolve(href, base) == wanted


def test_links():
    html = '<base href="https://www.b.example/d/"><a href="x">X <i>y</i></a><a href="https://B.example/">b</a><a href="http://c.example">c</a><a>n</a><a href=" # ">t</a><a href="JavaScript:x">j</a><a href="http://[">bad</a><a href=last>no end'
    found = page.extract_links(html, "https://a.example/")
    assert [(x["href"], x["text"], x["type"]) for x in found] == [
        ("https://www.b.example/d/x", "X y", "internal"),
        ("https://b.example/", "b", "internal"),
        ("http://c.example/", "c", "external"),
        ("https://www.b.example/d/last", "", "internal"),
    ]


def test_meta():
    html = (
        '<html lang="en"><head><title> A &amp;\n B </title><meta name=description content="D"><meta name="description" content="E"><meta name="robots" content="noindex">'
        '<meta property="" name="og:x" content="no"><meta property="og:image" content="1"><meta property="og:image" content="1"><meta name="twitter:card" content="c">'
        '<link rel="Canonical" href="/c"><link rel="shortcut icon" href="i.ico" sizes="16x16"><link rel=alternate type="application/rss+xml" href="/f" title=F>'
        '<script type="application/ld+json">{"a":1}</script></head><body><script type="application/ld+json">{bad</script><meta name="robots" content="late"></body></html>'
    )
    m = page.page_meta(html, "https://a.example/p")
    assert (m["title"], m["description"], m["robots"], m["language"], m["canonical"]) == ("A & B", "D", "noindex", "en", "https://a.example/c")
    assert m["og"] == {"image": "1"} and m["og_all"] == {"image": ["1", "1"]} and m["twitter"] == {"card": "c"}
    assert m["icons"] == [{"rel": "shortcut icon", "href": "https://a.example/i.ico", "sizes": "16x16"}]
    assert m["feeds"] == [{"href": "https://a.example/f", "title": "F", "type": "application/rss+xml"}]
    assert m["json_ld"] == ['{"a":1}']


@pytest.mark.parametrize(
    ("html", "how"),
    [
        (f"<article>short</article><article>{LONG}</article>", "article"),
        (f"<article>short</article><main>{LONG}</main>", "main"),
        (f'<div itemprop="articleBody">{LONG}</div>', "itemprop"),
        (f'<section class="x entry-content y">{LONG}</section>', "class"),
        ("<body>b</body>", "body"),
        ("text", "document"),
    ],
)
def test_main_content(html, how):
    assert page.main_content(html)[0] == how


def test_title_and_byline():
    assert page.page_title('<title>T</title><meta property="og:title" content="O &amp;amp; P">') == "O & P"
    assert page.page_title("<title> </title><h1>H</h1>") == ""
    assert page.page_title("<h1>H <b>x</b></h1>") == "H x"
    assert page.page_title("<p>x</p>") is None
    assert page.page_byline('<meta property="article:author" content="B"><meta name="Author" content=" A ">') == "A"


def test_feed():
    f = feed.parse_feed("<feed><title>t</title><link>plain</link><entry><title>e</title><link rel='self' href='s'/><link rel='related' href='r'/><content type='xhtml'><div>x</div></content></entry></feed>")
    assert (f["kind"], f["link"]) == ("atom", "plain")
    assert f["entries"][0]["link"] == "r" and f["entries"][0]["content"] is None and f["entries"][0]["content_type"] == "xhtml"
    assert feed.parse_feed("<rss><channel></rss>")["entries"] == []
    assert feed.parse_feed("<x:feed/>")["kind"] == "unknown"
    assert feed.parse_feed("<rss><channel><title>a &eacute; <![CDATA[<b>]]></title>")["title"] == "a é<b>"


def test_sitemap():
    assert sitemap.parse_sitemap("<urlset><url><loc>a</loc><priority>x</priority></url></urlset>")["urls"] == [{"loc": "a", "lastmod": None, "changefreq": None, "priority": None}]
    assert sitemap.decode_payload(gzip.compress(b"x")) == "x"
    with pytest.raises(sitemap.PayloadError):
        sitemap.decode_payload(gzip.compress(b"x" * 100)[:-9])


def test_robots():
    r = robots.parse_robots("Disallow: /x\nUser-agent: A\nUser-agent: b # c\n# only\nAllow:\nDisallow:\nCrawl-delay: 2s\n\nDisallow: /y\nSitemap: s\nnonsense")
    assert [g["agents"] for g in r["groups"]] == [["*"], ["a", "b"], ["*"]]
    assert r["groups"][1] == {"agents": ["a", "b"], "rules": [{"allow": False, "path": ""}], "crawl_delay": 2.0}
    assert r["sitemaps"] == ["s"]


@pytest.mark.parametrize(
    ("ip", "refused"),
    [(ip, True) for ip in ("0.1.1.1", "10.0.0.1", "100.64.0.1", "127.0.0.1", "169.254.169.254", "172.31.0.1", "192.0.0.1", "192.0.2.5", "192.168.1.1", "198.19.0.1", "198.51.100.1", "203.0.113.9", "224.0.0.1", "255.255.255.255", "::", "fd12::1", "ff02::1", "2001:db8::1", "febf::1", "::ffff:127.0.0.1", "fe80::1%eth0", "x")]
    + [(ip, False) for ip in ("8.8.8.8", "172.32.0.1", "100.128.0.1", "2606:4700::1", "fec0::1", "2002::1", "::ffff:8.8.8.8")],
)
def test_addresses(ip, refused):
    assert (net.address_refusal(ip) is not None) == refused


@pytest.mark.parametrize(
    ("u", "private", "ok"),
    [("https://a.example/", False, True), ("javascript:x", False, False), ("http://127.0.0.1", True, True), ("ftp://a", True, False), ("http://localhost.", False, False), ("", False, False), ("http://[fd00::1]/", False, False)],
)
def test_url_verdicts(u, private, ok):
    assert (net.url_refusal(u, private) is None) == ok


def test_version():
    import webloom
    from webloom.sources.http import USER_AGENT, user_agent

    assert USER_AGENT == f"webloom/{webloom.__version__}" and user_agent("9", "https://a.example") == "webloom/9 (+https://a.example)"
    assert re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+", webloom.__version__)


def test_first_element():
    assert tags.first_balanced_where("<P id=b>1</P><p id=b>2</p>", "P", lambda a: a.get("id") == "b") == "1"
    with pytest.raises(ValueError):
        tags.first_balanced_where("<p>", "p|b", lambda a: True)
