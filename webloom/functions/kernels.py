"""Kernels as Arrow functions: one Python call for each batch, an error field instead of failing jobs."""

from __future__ import annotations

from collections.abc import Callable
from inspect import Parameter, Signature
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webloom.functions import schemas as S
from webloom.kernel import bodies, feed, net, page, robots, sitemap, url
from webloom.kernel.markdown import html_to_markdown
from webloom.kernel.tags import first_balanced_where

#: Rows that a kernel has at a time, since pages can be large.
ROWS_AT_ONCE = 256


def plain(value: Any, kind: T.DataType) -> Any:
    """A value as Arrow takes it: maps as pairs, no lone surrogates."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value.encode("utf-8", "replace").decode()
    if isinstance(kind, T.StructType):
        return {f.name: plain(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return [(plain(k, kind.keyType), plain(v, kind.valueType)) for k, v in value.items()]
    return value


def kernel(work: Callable[..., Any], value_type: T.DataType) -> Callable[..., Column]:
    """``work`` as a function of Columns with the result struct<value, error>; a null first argument gives nulls.

    The function counts as nondeterministic, so that a filter on its result doesn't make Spark evaluate it twice.
    """
    kind = T.StructType([T.StructField("value", value_type), T.StructField("error", T.StringType())])

    def function(n: int) -> Any:
        arrow = to_arrow_type(kind)

        def one(first: Any, *rest: Any) -> dict[str, Any]:
            if first is None:
                return {"value": None, "error": None}
            try:
                return {"value": plain(work(first, *rest), value_type), "error": None}
            except (ValueError, RecursionError) as e:
                return {"value": None, "error": str(e) or type(e).__name__}

        def batch(*arrays):
            parts = [
                pa.array([one(*row) for row in zip(*(x.slice(a, ROWS_AT_ONCE).to_pylist() for x in arrays), strict=True)], arrow)
                for a in range(0, len(arrays[0]), ROWS_AT_ONCE)
            ]
            return pa.concat_arrays(parts) if parts else pa.array([], arrow)

        batch.__signature__ = Signature([Parameter(f"a{i}", Parameter.POSITIONAL_ONLY, annotation=pa.Array) for i in range(n)], return_annotation=pa.Array)
        return F.arrow_udf(batch, kind).asNondeterministic()

    def call(*columns: Column | str) -> Column:
        return function(len(columns))(*columns)

    call.function = function
    return call


def _parts(text: str) -> dict[str, Any]:
    u = url.parse(text)
    return {"scheme": u.scheme, "host": u.netloc, "origin": u.origin, "pathname": u.pathname, "search": u.search, "href": str(u)}


def _verdict(text: str, allow_private: bool | None = False) -> dict[str, Any]:
    why = net.url_refusal(text, bool(allow_private))
    return {"ok": why is None, "reason": why}


def _main(html: str) -> dict[str, Any]:
    how, content = page.main_content(html)
    return {"strategy": how, "content": content}


def _sitemap(body: bytes) -> dict[str, Any]:
    return sitemap.parse_sitemap(sitemap.decode_payload(body))


to_markdown = kernel(html_to_markdown, S.STRING)
read_article = kernel(lambda html, u: page.read_article(html, u or ""), S.ARTICLE)
page_title = kernel(page.page_title, S.STRING)
page_byline = kernel(page.page_byline, S.STRING)
page_meta = kernel(lambda html, u: page.page_meta(html, u or ""), S.META)
main_content = kernel(_main, S.MAIN)
first_element = kernel(lambda html, name, attribute, value: first_balanced_where(html, name, lambda a: a.get(attribute) == value), S.STRING)
extract_links = kernel(lambda html, u: page.extract_links(html, u or ""), S.LINKS)
url_parts = kernel(_parts, S.URL_PARTS)
resolve_url = kernel(url.resolve, S.STRING)
url_verdict = kernel(_verdict, S.VERDICT)
address_refusal = kernel(net.address_refusal, S.STRING)
address_number = kernel(net.address_number, S.ADDRESS)
range_pieces = kernel(net.range_pieces, S.PIECES)
decode_body = kernel(lambda body, content_type: bodies.decode_bytes(body, content_type or ""), S.STRING)
parse_feed = kernel(feed.parse_feed, S.FEED)
parse_sitemap = kernel(_sitemap, S.SITEMAP)
parse_robots = kernel(robots.parse_robots, S.ROBOTS)
