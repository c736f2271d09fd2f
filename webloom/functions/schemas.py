"""Types of what the kernels return."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, DOUBLE, BOOLEAN = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def strings(names: str) -> dict[str, T.DataType]:
    return {n: STRING for n in names.split()}


TEXTS = T.ArrayType(STRING)
ONE_EACH, SEVERAL_EACH = T.MapType(STRING, STRING), T.MapType(STRING, TEXTS)
LINKS = T.ArrayType(record(**strings("href text rel title type")))
META = record(
    **strings("url title description canonical language robots"),
    **{n: ONE_EACH for n in ("og", "twitter", "article")},
    **{n: SEVERAL_EACH for n in ("og_all", "twitter_all", "article_all")},
    icons=T.ArrayType(record(**strings("rel href sizes"))),
    feeds=T.ArrayType(record(**strings("href title type"))),
    json_ld=TEXTS,
)
ARTICLE = record(**strings("url title byline"), word_count=LONG, markdown=STRING)
MAIN = record(**strings("strategy content"))
ENTRY = record(**strings("title link id published updated author summary content content_type"), categories=TEXTS)
FEED = record(**strings("kind title description link updated"), entries=T.ArrayType(ENTRY))
SITEMAP = record(urls=T.ArrayType(record(**strings("loc lastmod changefreq"), priority=DOUBLE)), child_sitemaps=TEXTS)
RULES = T.ArrayType(record(allow=BOOLEAN, path=STRING))
ROBOTS = record(groups=T.ArrayType(record(agents=TEXTS, rules=RULES, crawl_delay=DOUBLE)), sitemaps=TEXTS)
URL_PARTS = record(**strings("scheme host origin pathname search href"))
ADDRESS = record(family=T.IntegerType(), high=LONG, low=LONG)
PIECES = T.ArrayType(record(family=T.IntegerType(), length=T.IntegerType(), high=LONG, low=LONG, width=STRING))
VERDICT = record(ok=BOOLEAN, reason=STRING)
RESPONSE = record(
    ok=BOOLEAN,
    status=T.IntegerType(),
    status_text=STRING,
    headers=ONE_EACH,
    url=STRING,
    redirects=TEXTS,
    body_text=STRING,
    body=T.BinaryType(),
    body_base64=STRING,
    json=STRING,
    truncated=BOOLEAN,
    duration_ms=LONG,
    error=STRING,
)
