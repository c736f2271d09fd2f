"""Small inline inputs for operators whose tables the data folders don't hold."""

from __future__ import annotations

import gzip
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from webloom.functions.schemas import RESPONSE
from webloom.sources.http import REQUEST, Raw

ROBOTS = "User-agent: *\nDisallow: /en/1\nAllow: /en/10\nDisallow: /de/*.html$ # pages\nDisallow: /*?utm_\nCrawl-delay: 1.5\n\nUser-agent: Bot\nDisallow: /\n\nSitemap: https://r.example/sitemap.xml\n"


def meta_pages(spark: SparkSession) -> DataFrame:
    first = '<head><meta property="og:title" content="First &amp; last"><meta property=og:image content="https://a.example/1.png"><meta property="og:image" content="https://a.example/2.png"></head>'
    return spark.createDataFrame([(1, "https://a.example/", first), (2, "https://a.example/2", '<meta name="og:title" content="">')], "page_id long, url string, html string")


def link_pages(spark: SparkSession) -> DataFrame:
    html = (
        '<a href="/in">in</a><a href="https://other.example/x?a=1>2" rel="nofollow">Other <b>&amp;</b> more</a><a href="#top">top</a><a href="mailto:a@b.example">mail</a>'
        '<a href="https://www.a.example/too">too</a><a title="B" href=http://b.example></a><a href="https://other.example/x?a=1>2">again</a>'
    )
    return spark.createDataFrame([(1, "https://a.example/p", html)], "page_id long, url string, html string")


def addresses(spark: SparkSession) -> DataFrame:
    ips = ["10.1.2.3", "8.8.8.8", "::1", "fe9f::1", "fec0::1", "::ffff:7f00:1", "::ffff:0808:0808", "64:ff9b::1", "1.2.3.999", "name"]
    return spark.createDataFrame([(ip,) for ip in ips], "ip string")


def urls(spark: SparkSession) -> DataFrame:
    rows = [(-1, "ftp://a.example/"), (-2, "http://0x7f.1/"), (-3, "https://a.localhost/"), (-4, "no url"), (-5, "http://[::1]:8080/")]
    return spark.createDataFrame(rows, "page_id long, url string")


def answers(spark: SparkSession) -> DataFrame:
    rows = [("good.example", 0, "93.184.216.34"), ("mixed.example", 0, "93.184.216.34"), ("mixed.example", 1, "10.0.0.1"), ("none.example", 0, None)]
    return spark.createDataFrame(rows, "host string, pos int, ip string")


def robots_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("https://r.example", 200, ROBOTS), ("https://none.example", 404, None)], "origin string, status int, body string")


def sitemap_site(spark: SparkSession) -> DataFrame:
    index = "".join(f"<sitemap><loc>https://s.example/{n}</loc></sitemap>" for n in ("a.xml", "b.xml.gz", "gone.xml"))
    a = "<url><loc> https://s.example/1 </loc><lastmod>2024-01-02</lastmod><changefreq>daily</changefreq><priority>0.8x</priority></url><url><loc>https://s.example/2</loc></url><url><lastmod>x</lastmod></url>"
    rows = [
        ("https://s.example/index.xml", 200, f"<sitemapindex>{index}</sitemapindex>".encode()),
        ("https://s.example/a.xml", 200, f'<?xml version="1.0"?><urlset xmlns="x">{a}</urlset>'.encode()),
        ("https://s.example/b.xml.gz", 200, gzip.compress(b"<urlset><url><loc>https://s.example/3</loc></url></urlset>")),
        ("https://s.example/gone.xml", 500, b"no"),
    ]
    return spark.createDataFrame([(u, s, bytearray(b)) for u, s, b in rows], "url string, status int, body binary")


def sitemap_seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "https://s.example/index.xml")], "crawl_id long, url string")


def feeds(spark: SparkSession) -> DataFrame:
    rss = (
        "<rss><channel><title>R</title><item><title>One &amp; two</title><link>https://f.example/1</link><guid isPermaLink='false'>id-1</guid><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate>"
        "<dc:creator>Bo</dc:creator><description>First</description><content:encoded><![CDATA[<b>x</b>]]></content:encoded><category>a</category><category>b</category></item><item><title>Next</title></item></channel></rss>"
    )
    atom = (
        '<feed><title>A</title><link rel="self" href="https://f.example/self"/><entry><title type="text">Entry</title><link rel="self" href="https://f.example/no"/><link href="https://f.example/e"/><id>urn:1</id>'
        '<published>2024-01-01T00:00:00Z</published><author><name>Ann</name></author><summary>Short</summary><content type="html">&lt;p&gt;Long&lt;/p&gt;</content><category term="news"/><category label="misc"/></entry></feed>'
    )
    return spark.createDataFrame([("rss", rss), ("atom", atom), ("other", "<rdf><item/></rdf>")], "feed_id string, body string")


def content_types(spark: SparkSession) -> DataFrame:
    kinds = ["text/html; charset=UTF-8", "application/json", "application/ld+json; charset=utf8", "image/png", "", "image/svg+xml", "application/octet-stream", 'text/plain; charset="iso8859-1"']
    return spark.createDataFrame([(k,) for k in kinds], "content_type string")


def retries(spark: SparkSession) -> DataFrame:
    now = 1_792_567_680_000  # 2026-10-21 07:28:00 UTC
    rows = [(0, None), (1, None), (5, None), (0, "3"), (0, "900"), (2, "soon"), (0, "Wed, 21 Oct 2026 07:28:30 GMT"), (0, "Wed, 21 Oct 2020 07:28:00 GMT")]
    return spark.createDataFrame([(a, h, now) for a, h in rows], "attempt int, header string, now_ms long")


def redirects(spark: SparkSession) -> DataFrame:
    rows = [("a", 302, "/b"), ("b", 301, "c?x=1"), ("c?x=1", 200, None), ("loop", 302, "/loop")]
    return spark.createDataFrame([(f"https://r.example/{p}", s, to) for p, s, to in rows], "url string, status int, location string")


def redirect_requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"https://r.example/{p}") for i, p in ((1, "a"), (2, "loop"), (3, "none"))], "request_id long, url string")


#: Responses by method, URL and attempt.
CAPTURED: list[dict[str, Any]] = [
    {"url": "https://h.example/start", "status": 302, "headers": {"Location": "/middle"}},
    {"url": "https://h.example/middle", "status": 307, "headers": {"location": "end"}},
    {"url": "https://h.example/end", "status": 200, "status_text": "OK", "headers": {"Content-Type": "text/plain"}, "body": "done"},
    {"url": "https://h.example/end", "method": "HEAD", "status": 200, "status_text": "OK", "headers": {"Content-Type": "text/plain"}},
    {"url": "https://h.example/busy", "attempt": 0, "status": 503, "headers": {"Retry-After": "0"}},
    {"url": "https://h.example/busy", "attempt": 1, "status": 200, "headers": {"Content-Type": "text/plain"}, "body": "ready"},
    {"url": "https://h.example/big", "status": 200, "headers": {"Content-Type": "text/plain"}, "body": "0123456789"},
    {"url": "https://h.example/inside", "status": 301, "headers": {"Location": "http://10.0.0.8/x"}},
]


def requests(spark: SparkSession) -> DataFrame:
    asked = [
        {"url": "https://h.example/start"},
        {"url": "https://h.example/busy", "retries": 1},
        {"url": "https://h.example/big", "max_bytes": 5},
        {"url": "http://127.0.0.1/"},
        {"url": "https://h.example/inside"},
        {"url": "https://h.example/end", "method": "HEAD"},
        {"url": "https://h.example/end", "method": "POST"},
    ]
    schema = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("request", REQUEST)])
    return spark.createDataFrame([(i, {"method": "GET", **r}) for i, r in enumerate(asked, 1)], schema)


def responses(spark: SparkSession) -> DataFrame:
    made = [
        {"ok": True, "status": 200, "status_text": "OK", "headers": {"b": "2", "a": "1"}, "url": "https://a.example/", "redirects": ["https://a.example/"], "body_text": "hello", "truncated": True, "duration_ms": 12},
        {"ok": False, "status": 0, "status_text": "", "headers": {}, "url": "https://a.example/", "redirects": [], "truncated": False, "duration_ms": 3, "error": "exceeded 5 redirects"},
        {"ok": False, "status": 404, "status_text": "", "headers": {}, "url": "https://a.example/x", "redirects": [], "body_text": '{"a":[1]}', "json": '{"a":[1]}', "truncated": False, "duration_ms": 1},
    ]
    schema = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("response", RESPONSE)])
    return spark.createDataFrame(list(enumerate(made, 1)), schema)


class Echo:
    """Answers with what it was sent: a path that begins with /r redirects to another host, /j is JSON, /b is bytes."""

    def resolve(self, host: str) -> list[str]:
        return ["93.184.216.34"]

    def send(self, method: str, url: Any, address: str, headers: dict[str, str], body: bytes | None, timeout_s: float, max_bytes: int) -> Raw:
        if url.pathname.startswith("/r"):
            return Raw(307 + int(url.pathname[2:]) % 2, "Redirect", {"Location": f"https://other.example/t{url.pathname[2:]}"})
        said = f"{method} {url.pathname}\n".encode() + "".join(f"{k}: {v}\n" for k, v in sorted(headers.items())).encode() + b"\n" + (body or b"")
        kind = {"j": "application/problem+json", "b": "image/png"}.get(url.pathname[1:2], "text/plain")
        return Raw(201, "Created", {"Content-Type": kind, "X-Method": method}, (body or b"null") if kind.endswith("json") else said)
