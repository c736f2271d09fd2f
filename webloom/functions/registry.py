"""The kernels as named SQL functions, links as a table function for lateral joins, and the Arrow table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import kernels as K
from webloom.functions import schemas as S
from webloom.functions import tables
from webloom.kernel import page

#: Name, kernel, number of arguments. All return struct<value, error>.
FUNCTIONS = (
    ("web_markdown", K.to_markdown, 1),
    ("web_article", K.read_article, 2),
    ("web_title", K.page_title, 1),
    ("web_byline", K.page_byline, 1),
    ("web_meta", K.page_meta, 2),
    ("web_main_content", K.main_content, 1),
    ("web_first_element", K.first_element, 4),
    ("web_links", K.extract_links, 2),
    ("web_url_parts", K.url_parts, 1),
    ("web_resolve_url", K.resolve_url, 2),
    ("web_url_verdict", K.url_verdict, 1),
    ("web_address_refusal", K.address_refusal, 1),
    ("web_decode_body", K.decode_body, 2),
    ("web_feed", K.parse_feed, 1),
    ("web_sitemap", K.parse_sitemap, 1),
    ("web_robots", K.parse_robots, 1),
)


class LinkRows:
    """One row for each link of a page."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for i, link in enumerate(page.extract_links(html or "", url or "")):
            yield (i, *(link[n] for n in ("href", "text", "rel", "title", "type")))


def register(spark: SparkSession) -> None:
    for name, kernel, n in FUNCTIONS:
        spark.udf.register(name, kernel.function(n))
    fields = [T.StructField("pos", T.LongType()), *S.LINKS.elementType.fields]
    spark.udtf.register("web_link_rows", F.udtf(LinkRows, returnType=T.StructType(fields)))
    tables.register(spark)
