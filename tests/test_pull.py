"""Pull parsing against the tree, and table functions against their DataFrame twins."""

import gzip
import random
import time
import tracemalloc

import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from webloom.functions import registry
from webloom.functions.tables import rows_of
from webloom.kernel import feed, sitemap, xml
from webloom.operators import feeds, pages, robots, sitemaps
from webloom.plans import generated
from webloom.tables import table

PIECES = [
    "<urlset>", "</urlset>", "<url>", "</url>", "<loc>", "</loc>", "<loc a='1>'>", "<url/>", "x", "&amp;", " y ", "<!-- c -->", "<![CDATA[ <q> ]]>", "<?p?>", "<!DOCTYPE a [ <!ENTITY b 'c'> ]>", "<!x>", "<!--", "<![CDATA[", "<?",
    "<", "< ", '<a "', "'", '"', ">", "</loc", "<loc", "<sitemapindex>", "<sitemap>", "</sitemap>", "<b:c d=\"e<f\">", "]", "-->", "]]>", "?>", "\n", "<loc>http://a/1</loc>", "<rss>", "<channel>", "<item>", "</item>", "</channel>", "<feed>",
    "<entry>", "</entry>", "<title>t</title>", "<link href='h' rel=\"self\"/>",
]


def shown(e):
    return e.name, e.attributes, e.pieces, [shown(c) for c in e.children]


def chunks(text, size):
    return (text[a : a + size] for a in range(0, len(text), size))


@pytest.mark.parametrize("seed", range(20))
def test_elements_are_the_trees(seed):
    r = random.Random(seed)
    for _ in range(400):
        pieces = r.sample(PIECES, r.randint(3, len(PIECES)))
        text = r.choice(["", "<urlset>"]) + "".join(r.choice(pieces) for _ in range(r.randint(0, 30)))
        tree = xml.parse(text)
        size = r.choice([1, 2, 3, 7, 1000])
        found = [shown(e) for _, e in xml.pulled(chunks(text, size), [("urlset", "url")])]
        assert found == [shown(e) for g in tree.all("urlset")[:1] for e in g.all("url")], (text, size)
        items = [shown(e) for _, e in xml.pulled(chunks(text, size), [("rss", "channel", "item")])]
        assert items == [shown(e) for g in tree.all("rss")[:1] for c in g.all("channel")[:1] for e in c.all("item")], (text, size)


def test_any_name():
    found = [(p, e.name) for p, e in xml.pulled(["<a><b>1</b><c/><b>2</b><d><b/></d></a><a><b/></a>"], [("a", "b"), ("a", "*")])]
    assert found == [(("a", "b"), "b"), (("a", "*"), "c"), (("a", "b"), "b"), (("a", "*"), "d")]


def test_feeds_and_sitemaps_by_pieces(spark):
    for body in [r.body for r in generated.feeds(spark, SMALL).collect()]:
        assert list(feed.feed_entries(chunks(body, 100))) == feed.parse_feed(body)["entries"]
    for r in generated.sitemap_site(spark, SMALL).collect():
        for data in (bytes(r.body), gzip.compress(bytes(r.body)), b"\xef\xbb\xbf" + bytes(r.body)):
            found = list(sitemap.sitemap_entries(sitemap.payload_chunks(data, size=11)))
            whole = sitemap.parse_sitemap(sitemap.decode_payload(data))
            assert [e for child, e in found if not child] == whole["urls"] and [e["loc"] for child, e in found if child] == whole["child_sitemaps"]


def test_packed_bodies_are_bounded():
    with pytest.raises(sitemap.PayloadError):
        list(sitemap.payload_chunks(gzip.compress(b"x" * 5000), 4999))
    assert "".join(sitemap.payload_chunks(gzip.compress(b"x" * 5000) + gzip.compress("é".encode()), 6000, 3)) == "x" * 5000 + "é"


def test_memory_does_not_follow_the_document():
    def peak(n):
        made = (f"<url><loc>https://a.example/{i}</loc><lastmod>2024-01-01</lastmod></url>" for i in range(n))
        tracemalloc.start()
        count = sum(1 for _ in sitemap.sitemap_entries(x for part in (["<urlset>"], made) for x in part))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return count, most

    (few, small), (many, large) = peak(500), peak(20_000)
    assert (few, many) == (500, 20_000) and large < 2 * small + 200_000


@pytest.mark.parametrize("text", ['<a "' * 50_000, "<!--" + "x" * 3_000_000, "<![CDATA[" + "y" * 3_000_000 + "]]>", "<urlset><url><loc>" + "z" * 3_000_000 + "</loc>", "<" * 100_000, "<a 'x" * 20_000])
def test_broken_markup_is_linear(text):
    began = time.perf_counter()
    list(xml.pulled(chunks(text, 1 << 16), [("urlset", "url")]))
    assert time.perf_counter() - began < 3


def same(spark, sql, twin):
    found, wanted = spark.sql(sql), twin.select(*spark.sql(sql).columns)
    a, b = sorted(map(repr, found.collect())), sorted(map(repr, wanted.collect()))
    assert a == b and a


def test_sql_functions_are_their_twins(spark):
    """Five table functions, each as a DataFrame operator that finds its rows in another way."""
    registry.register(spark)
    table(spark, SMALL, "pages").createOrReplaceTempView("t_pages")
    same(spark, "select page_id, pos, href, text, type from web_links_of(table(select page_id, url, html, 1 as x from t_pages))", pages.links(table(spark, SMALL, "pages"), dedupe=False, limit=None))
    heads = generated.meta_pages(spark, SMALL)
    heads.createOrReplaceTempView("t_heads")
    firsts = pages.meta_values(heads, "og").select("page_id", "key", F.col("first").alias("value"))
    same(spark, "select page_id, key, value from web_meta_of(table(t_heads)) where kind = 'og' and pos = 0", firsts)
    bodies = generated.feeds(spark, SMALL)
    bodies.createOrReplaceTempView("t_feeds")
    same(spark, "select feed_id, pos, title, link, author, categories from web_feed_entries_of(table(t_feeds))", feeds.feed_entries(bodies, 500))
    site = generated.packed_sitemaps(spark, SMALL)
    site.createOrReplaceTempView("t_sitemaps")
    whole = sitemaps.parsed(site).select("url", F.posexplode("urls").alias("pos", "u")).select("url", F.col("pos").cast("long").alias("pos"), "u.loc", "u.priority")
    cut_off = spark.sql("select distinct url from web_sitemap_entries_of(table(select url, body from t_sitemaps where status = 200)) where error is not null")
    streamed = spark.sql("select url, pos, loc, priority from web_sitemap_entries_of(table(select url, body from t_sitemaps)) where not child").join(cut_off, "url", "left_anti")
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, whole.collect()))
    files = generated.robots_files(spark, SMALL)
    files.createOrReplaceTempView("t_robots")
    same(spark, "select * from web_robots_rules_of(table(select origin, body from t_robots))", robots.rules(robots.files(files)))


def test_inputs_that_cannot_be_read(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "https://a.example/", "<a href=x>1</a>"), (3, None, "<meta property=og:x content='&#1114112;'>")], "page_id long, url string, html string")
    assert [(r.page_id, r.href) for r in rows_of(rows, "web_links_of").collect()] == [(2, "https://a.example/x")]
    assert rows_of(rows, "web_meta_of").count() == 0
    many = spark.createDataFrame([(1, "https://a.example/", "<a href=x>1</a>" * 9000)], rows.schema)
    assert rows_of(many, "web_links_of").count() == 9000
