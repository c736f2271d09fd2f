"""Operators over DataFrames: nulls, limits, order, errors per row, and what the fetch layer does."""

import gzip
import http.server
import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest
from oracle import assert_same, connection
from pyspark.sql import functions as F

from webloom.functions import http as H
from webloom.functions import kernels as K
from webloom.functions import text as X
from webloom.functions.registry import register
from webloom.operators import feeds, pages, robots, sitemaps
from webloom.plans import catalog
from webloom.sources import exchange as E
from webloom.sources import http as S
from webloom.sources import lanes
from webloom.streaming.pages import links_per_host, unique_links


def frame(spark, rows, schema="page_id long, url string, html string"):
    return spark.createDataFrame(rows, schema)


def test_null_and_empty_pages(spark):
    df = frame(spark, [(1, "https://a.example/", None), (2, None, ""), (3, "https://a.example/", "<p>&#1114112;</p><meta name=a content='&#1114112;'>")])
    assert {r.page_id: r.error for r in pages.plain_text(df).collect()} == {1: "response body was empty", 2: "response body was empty", 3: None}
    found = {r.page_id: r for r in pages.metadata(df).collect()}
    assert found[1].error == "empty body" and "out of range" in found[3].error
    assert pages.links(df).count() == 0 and pages.articles(df).count() == 3 and pages.markdown(df).count() == 3


def test_link_limits(spark):
    html = "".join(f'<a href="/{i % 4}">{i}</a>' for i in range(10))
    df = frame(spark, [(1, "https://a.example/", html)])
    assert [(r.pos, r.href[-1], r.text) for r in pages.links(df).orderBy("pos").collect()] == [(i, str(i), str(i)) for i in range(4)]
    first = pages.links(df, limit=4).first()
    assert (first.link_count, first.truncated) == (4, False)
    first = pages.links(df, limit=3).first()
    assert (first.link_count, first.truncated) == (3, True)
    assert pages.links(df, dedupe=False, limit=None).count() == 10
    assert pages.links(df, kind="external").count() == 0
    with pytest.raises(ValueError):
        pages.links(df, kind="other")


def test_links_are_not_shuffled(spark):
    df = frame(spark, [(1, "https://a.example/", "<a href=x>")])
    assert "Exchange" not in pages.links(df)._jdf.queryExecution().executedPlan().toString()


def test_feed_limit(spark):
    body = "<rss><channel>" + "".join(f"<item><title>{i}</title></item>" for i in range(5)) + "</channel></rss>"
    df = spark.createDataFrame([("f", body), ("n", None)], "feed_id string, body string")
    head = {r.feed_id: r for r in feeds.feeds(df, 3).collect()}
    assert (head["f"].entry_count, head["f"].truncated, len(head["f"].entries)) == (5, True, 3) and head["n"].error == "empty body"
    assert [r.title for r in feeds.feed_entries(df, 3).orderBy("pos").collect()] == ["0", "1", "2"]


def test_robots_verdicts(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/public\nDisallow: /api/*.json$\n\nUser-agent: goodbot\nDisallow: /\nAllow: /a.b\nDisallow: /a.b\n"
    files = robots.files(spark.createDataFrame([("https://a.example", 200, body), ("https://gone.example", 404, None), ("https://bad.example", 500, "x")], "origin string, status int, body string"))
    urls = ["https://a.example/", "https://a.example/private/x", "https://a.example/private/public/p", "https://a.example/api/i.json", "https://a.example/api/i.xml", "https://gone.example/x", "https://bad.example/", "https://none.example/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.allowed, r.matched_rule) for r in robots.verdicts(df, files).collect()}
    assert got == {0: (True, None), 1: (False, "Disallow: /private"), 2: (True, "Allow: /private/public"), 3: (False, "Disallow: /api/*.json$"), 4: (True, None), 5: (True, None), 6: (None, None), 7: (True, None)}
    named = {r.page_id: r.allowed for r in robots.verdicts(spark.createDataFrame([(0, "https://a.example/z"), (1, "https://a.example/a.b")], "page_id long, url string"), files, "GoodBot/2.0").collect()}
    assert named == {0: False, 1: True}


def test_sitemap_crawl_limits(spark):
    site = spark.createDataFrame(
        [("r", 200, bytearray(b"<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>"))]
        + [(n, 200, bytearray(f"<urlset><url><loc>{n}1</loc></url><url><loc>{n}2</loc></url></urlset>".encode())) for n in "ab"]
        + [("bad", 500, bytearray(b""))],
        "url string, status int, body binary",
    )
    seeds = spark.createDataFrame([(1, "r"), (2, "bad")], "crawl_id long, url string")
    got = sitemaps.crawl(seeds, site, max_depth=1, max_urls=2)
    assert [r.loc for r in got["urls"].orderBy("pos").collect()] == ["a1", "a2"]
    summary = {r.crawl_id: r for r in got["summary"].collect()}
    assert summary[1].truncated and summary[1].url_count == 2 and summary[2].error == "HTTP 500"
    flat = sitemaps.crawl(seeds, site, max_depth=0)
    assert flat["urls"].count() == 0 and flat["children"].count() == 3
    every = sitemaps.crawl(seeds, site, max_depth=3)
    assert every["urls"].count() == 4 and every["visited"].where("crawl_id = 1").count() == 3


def test_sitemap_crawl_of_all_urls(spark, tmp_path):
    """A region with more URLs than a crawl takes by default."""
    con = connection()
    for t in ("region", "nation"):
        con.sql(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    con.sql(f"copy (select i as s_suppkey, (i % 2)::int as s_nationkey from range(10400) t(i)) to '{tmp_path}/supplier.parquet' (format parquet)")
    con.sql(f"create or replace view supplier as select * from '{tmp_path}/supplier.parquet'")
    assert_same(catalog.sitemap_crawl(spark, str(tmp_path)).toPandas(), con.sql(catalog.ORACLES["sitemap_crawl"]).df())
    site = spark.createDataFrame([("r", 200, bytearray(b"<urlset><url><loc>1</loc></url><url><loc>2</loc></url></urlset>"))], "url string, status int, body binary")
    seeds = spark.createDataFrame([(1, "r")], "crawl_id long, url string")
    assert [(r.url_count, r.truncated) for r in sitemaps.crawl(seeds, site, max_urls=None)["summary"].collect()] == [(2, False)]


def test_text_functions(spark):
    r = spark.createDataFrame([("a😀b", " x\n\u00a0y ")], "a string, b string").select(
        X.utf16_len(F.col("a")).alias("n"), X.collapse(F.col("b")).alias("c"), X.word_count(F.col("b")).alias("w"), X.display_cap(F.col("b"), 2).alias("d"), X.normalized_host(F.lit("WWW.A.b")).alias("h")
    ).first()
    assert (r.n, r.c, r.w, r.h) == (4, "x y", 2, "a.b") and r.d.startswith(" x\n\n[... truncated 4")


def test_limited_body(spark):
    body, more = H.limited_body(F.col("b"), 3)
    rows = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"abcd"),), (None,)], "b binary").select(body.alias("b"), more.alias("m")).collect()
    assert [(bytes(r.b) if r.b else None, r.m) for r in rows] == [(b"abc", False), (b"abc", True), (None, False)]


def test_fetch_rules():
    rows = [
        {"url": "https://a.example/1", "method": "POST", "status": 302, "headers": {"Location": "https://b.example/2"}},
        {"url": "https://b.example/2", "status": 200, "body": b"\xe9", "headers": {"Content-Type": "text/plain; charset=iso-8859-1"}},
        {"url": "https://a.example/loop", "status": 301, "headers": {"Location": "loop"}},
        {"url": "https://a.example/json", "status": 200, "body": '{"a":1,"a":2}', "headers": {"Content-Type": "application/json"}},
        {"url": "https://a.example/bin", "status": 200, "body": b"\x00", "headers": {"Content-Type": "image/png"}},
        {"url": "https://a.example/429", "status": 429, "headers": {"Retry-After": "90"}},
    ]
    sent, waits = [], []

    class Seen(S.Captured):
        def send(self, method, url, address, headers, body, timeout_s, max_bytes):
            sent.append((method, str(url), headers.get("authorization"), body))
            return super().send(method, url, address, headers, body, timeout_s, max_bytes)

    t = Seen(rows, {"private.example": ["93.184.216.34", "10.0.0.1"], "none.example": []})
    get = lambda **r: S.fetch_one(S.Request.of(r), t, waits.append)
    r = get(url="https://a.example/1", method="POST", body="x", bearer_token="t", content_type="text/plain")
    assert (r["status"], r["body_text"], r["redirects"]) == (200, "é", ["https://b.example/2"])
    assert sent == [("POST", "https://a.example/1", "Bearer t", b"x"), ("GET", "https://b.example/2", None, None)]
    assert get(url="https://a.example/loop", max_redirects=2)["error"] == "exceeded 2 redirects"
    assert get(url="https://a.example/json")["json"] == '{"a": 2}'
    assert get(url="https://a.example/bin")["body"] == b"\x00" and "body_text" not in get(url="https://a.example/bin")
    assert get(url="https://a.example/429", retries=2)["status"] == 429 and waits == [60.0, 60.0]
    assert "10.0.0.1" in get(url="https://private.example/")["error"]
    assert get(url="https://none.example/")["error"] == "DNS: none.example returned no addresses"
    assert S.fetch_one(S.Request("https://a.example/"), S.Refused())["status"] == 0


def test_bodies_of_requests_and_responses():
    seen = []

    class Seen(S.Captured):
        def send(self, method, url, address, headers, body, timeout_s, max_bytes):
            seen.append((method, body, headers.get("content-type")))
            return super().send(method, url, address, headers, body, timeout_s, max_bytes)

    t = Seen([{"url": "https://a.example/", "method": m, "status": 200, "body": b"\xff\x00", "headers": {"Content-Type": k}} for m, k in (("GET", "image/png"), ("PUT", "text/plain"), ("HEAD", "text/plain"), ("DELETE", "text/plain"))])
    get = lambda **r: S.fetch_one(S.Request.of({"url": "https://a.example/", **r}), t)
    for method in ("GET", "HEAD", "PUT", "DELETE"):
        get(method=method, body="x", content_type="text/plain")
    assert seen == [("GET", None, None), ("HEAD", None, None), ("PUT", b"x", "text/plain"), ("DELETE", b"x", "text/plain")]
    r = get()
    assert (r["body_base64"], "body_text" in r) == ("/wA=", False)
    assert get(method="PUT", decode_text=False)["body_base64"] == "/wA=" and "body_base64" not in get(method="PUT")
    assert get(decode_text=True)["body_text"] == "\ufffd\x00"


def test_packed_bodies_are_bounded():
    from webloom.kernel import sitemap

    body = gzip.compress(b"x" * 5000)
    assert sitemap.decode_payload(body, 5000) == "x" * 5000 and sitemap.decode_payload(body + gzip.compress(b"y"), 6000) == "x" * 5000 + "y"
    with pytest.raises(sitemap.PayloadError):
        sitemap.decode_payload(body, 4999)


def test_a_lost_task_sends_nothing_again(tmp_path):
    """A task that dies after it sent a request is run again; the request isn't."""
    code = f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from webloom.sources import exchange as E
from webloom.sources import http as S
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

class Dying(S.Captured):
    def send(self, method, url, address, headers, body, timeout_s, max_bytes):
        with open({str(tmp_path / "sent")!r}, "a") as f:
            print(url, file=f)
        if url.pathname == "/3":
            os._exit(1)
        return S.Raw(201)

df = spark.createDataFrame([(i, {{"url": f"https://a.example/{{i}}", "method": "POST"}}) for i in range(6)], "request_id long, request struct<url:string,method:string>")
for _ in range(2):
    got = {{r.request_id: r.response for r in E.send(df, Dying([]), {str(tmp_path / "log")!r}, lease_s=2).collect()}}
    assert len(got) == 6 and got[3].status == 0 and got[3].error == S.UNKNOWN, got
# A log of intents without responses, as a lost job leaves it.
spark.createDataFrame([(9,)], "request_id long").write.mode("append").parquet({str(tmp_path / "log" / "intents")!r})
more = df.limit(0).unionByName(spark.createDataFrame([(9, {{"url": "https://a.example/9", "method": "POST"}})], df.schema))
got = {{r.request_id: r.response for r in E.send(more, Dying([]), {str(tmp_path / "log")!r}, lease_s=2).collect()}}
assert got[9].error == S.UNKNOWN and got[9].url == "https://a.example/9" and len(got) == 7
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    sent = (tmp_path / "sent").read_text().split()
    assert len(sent) == len(set(sent)) and "https://a.example/3" in sent and "https://a.example/9" not in sent


def test_requests_go_at_once(spark):
    class Slow(S.Captured):
        def send(self, method, url, address, headers, body, timeout_s, max_bytes):
            import threading

            lock = self.__dict__.setdefault("lock", threading.Lock())
            host = url.netloc
            with lock:
                self.under_way[host] = self.under_way.get(host, 0) + 1
                most = self.under_way[host]
            time.sleep(0.2)
            with lock:
                self.under_way[host] -= 1
            return S.Raw(200, headers={"content-type": "text/plain"}, body=str(most).encode())

    t = Slow([])
    t.under_way = {}
    df = spark.createDataFrame([(i, {"url": f"https://h{i % 4}.example/{i}", "method": "GET"}) for i in range(32)], "request_id long, request struct<url:string,method:string>").coalesce(1)
    began = time.monotonic()
    got = S.fetch(df, t).collect()
    assert [r.request_id for r in sorted(got)] == list(range(32)) and time.monotonic() - began < 5
    assert 1 < max(int(r.response.body_text) for r in got) <= lanes.PER_HOST


def test_send_is_logged(spark, tmp_path):
    df = spark.createDataFrame([(1, {"url": "https://a.example/p", "method": "POST"})], "request_id long, request struct<url:string,method:string>")
    t = S.Captured([{"url": "https://a.example/p", "method": "POST", "status": 201}])
    for _ in range(2):
        assert E.send(df, t, str(tmp_path / "log")).count() == 1


def test_network(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/r":
                self.send_response(302)
                self.send_header("Location", "/end")
                self.end_headers()
                return
            self.send_response(200)
            self.send_header("Content-Type", "text/plain")
            self.end_headers()
            if self.path == "/drip":
                try:
                    for _ in range(100):
                        self.wfile.write(b"x")
                        self.wfile.flush()
                        time.sleep(0.1)
                except OSError:
                    pass
                return
            self.wfile.write(b"x" * 10)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        r = S.fetch_one(S.Request(f"{at}/r", allow_private_hosts=True, max_bytes=4), S.Network())
        assert (r["status"], r["body_text"], r["truncated"], r["url"]) == (200, "xxxx", True, f"{at}/end")
        assert S.fetch_one(S.Request(f"{at}/r"), S.Network())["error"].startswith("IPv4 address 127.0.0.1")
        began = time.monotonic()
        r = S.fetch_one(S.Request(f"{at}/drip", allow_private_hosts=True, timeout_ms=500), S.Network())
        assert (r["status"], r["error"]) == (0, "request exceeded 500ms") and time.monotonic() - began < 3
    finally:
        server.shutdown()


def test_stream(spark, tmp_path):
    rows = spark.sql("select 1L as page_id, 'https://a.example/' as url, '<a href=x>1</a><a href=x>2</a><a href=y>3</a>' as html, timestamp'2024-01-01' as seen_at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = unique_links(stream, "1 hour").writeStream.format("memory").queryName("unique_links").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("unique_links").count() == 2
    query = links_per_host(stream, "1 hour", "1 hour").writeStream.format("memory").queryName("hosts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.host, r.n) for r in spark.table("hosts").collect()] == [("a.example", 3)]


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select web_title('<title>t</title>').value as title, web_resolve_url('b', 'http://a/').value as url, web_markdown('<b>x</b>').value as md, size(web_links('<a href=x>', 'http://a/').value) as n").first()
    assert (r.title, r.url, r.md, r.n) == ("t", "http://a/b", "**x**", 1)
    rows = spark.sql("select href, type from web_link_rows('<a href=x>1</a><a href=y>2</a>', 'http://a/')").collect()
    assert [r.href for r in rows] == ["http://a/x", "http://a/y"]


def test_bodies(spark):
    rows = [(bytearray(b"\xe9"), "text/plain; charset=ISO-8859-1"), (bytearray(b"\xef\xbb\xbfa\xff"), "text/html"), (bytearray(b"x"), "text/html; charset=nonsense"), (bytearray(b"\x80"), "a; charset=latin1"), (None, "a")]
    df = spark.createDataFrame(rows, "body binary, kind string")
    assert [r.t for r in df.select(K.decode_body("body", "kind")["value"].alias("t")).collect()] == ["é", "a\ufffd", "x", "€", None]
    j = spark.createDataFrame([('{"a":1}', "application/json", False), ("{bad", "application/json", False), ('{"a":1}', "text/plain", False), ('{"a":1}', "x/y+json", True)], "t string, kind string, cut boolean")
    got = j.select(H.json_body(F.col("t"), F.col("kind"), F.col("cut")).cast("string").alias("j"), H.basic_authorization(F.lit("u"), F.lit("p")).alias("b")).collect()
    assert [r.j for r in got] == ['{"a":1}', None, None, None] and got[0].b == "Basic dTpw"


def test_written_tables_are_cleared(spark):
    from pathlib import Path

    from webloom import cut

    path = Path(cut.written(spark.range(3), "x").inputFiles()[0].removeprefix("file://")).parent
    assert path.exists() and cut.clear_written(spark) and not path.exists()


def test_small_batches_keep_a_named_size(spark):
    from webloom import cut

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "777")
        cut.small_batches(spark)
        assert spark.conf.get(key) == "777"
        spark.conf.unset(key)
        cut.small_batches(spark)
        assert spark.conf.get(key) == str(cut.ROWS_IN_BATCH)
    finally:
        spark.conf.set(key, before)
