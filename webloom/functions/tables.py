"""Rows of pages, feeds, sitemaps and robots files as Arrow table functions: a batch of inputs in, bounded batches of rows out.

In SQL they take a table: ``select * from web_links_of(table(select page_id, url, html from pages))``. Spark doesn't allow Arrow table functions in a
lateral join, so each passes on the key of its input; where a lateral join is wanted, there is ``web_link_rows``. A DataFrame takes ``rows_of``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webloom.functions import schemas as S
from webloom.functions.kernels import plain
from webloom.kernel import feed, page, robots, sitemap

#: Rows of a batch that goes out, inputs that are turned into Python values at a time.
ROWS_OUT, INPUTS = 2048, 64
Row = tuple[Any, ...]


def _links(page_id: int, url: str | None, html: str | None) -> Iterator[Row]:
    for i, x in enumerate(page.extract_links(html or "", url or "")):
        yield page_id, i, x["href"], x["text"], x["rel"], x["title"], x["type"]


def _meta(page_id: int, url: str | None, html: str | None) -> Iterator[Row]:
    found = page.page_meta(html or "", url or "")
    for key in ("title", "description", "canonical", "language", "robots"):
        if found[key] is not None:
            yield page_id, "page", key, 0, found[key]
    for kind in ("og", "twitter", "article"):
        for key, value in found[kind].items():
            for i, v in enumerate(found[f"{kind}_all"].get(key, [value])):
                yield page_id, kind, key, i, v
    for i, x in enumerate(found["icons"]):
        yield page_id, "icon", x["rel"], i, x["href"]
    for i, x in enumerate(found["feeds"]):
        yield page_id, "feed", x["type"], i, x["href"]
    for i, x in enumerate(found["json_ld"]):
        yield page_id, "json_ld", None, i, x


def _pieces(text: str, size: int = 1 << 16) -> Iterator[str]:
    return (text[a : a + size] for a in range(0, len(text), size))


def _feed_entries(feed_id: str, body: str | None) -> Iterator[Row]:
    for i, e in enumerate(feed.feed_entries(_pieces(body or ""))):
        yield feed_id, i, *(e[n] for n in feed.FIELDS), e["categories"]


def _sitemap_entries(url: str, body: bytes | None) -> Iterator[Row]:
    """Entries as they are read; where the body can't be read on, a last row says why."""
    counts = [0, 0]
    try:
        for child, e in sitemap.sitemap_entries(sitemap.payload_chunks(body or b"")):
            yield url, counts[child], child, e["loc"], e["lastmod"], e["changefreq"], e["priority"], None
            counts[child] += 1
    except ValueError as e:
        yield url, None, None, None, None, None, None, f"parse failed: {e}"


def _robots_rules(origin: str, body: str | None) -> Iterator[Row]:
    for g, group in enumerate(robots.parse_robots(body or "")["groups"]):
        for agent in group["agents"]:
            for i, rule in enumerate(group["rules"]):
                yield origin, g, agent, i, rule["allow"], rule["path"], group["crawl_delay"]


_LONG, _TEXT = T.LongType(), T.StringType()
#: What a function takes, its rows of one input, and its columns.
TABLES: dict[str, tuple[tuple[str, ...], Callable[..., Iterator[Row]], T.StructType]] = {
    "web_links_of": (("page_id", "url", "html"), _links, S.record(page_id=_LONG, pos=_LONG, **S.strings("href text rel title type"))),
    "web_meta_of": (("page_id", "url", "html"), _meta, S.record(page_id=_LONG, kind=_TEXT, key=_TEXT, pos=_LONG, value=_TEXT)),
    "web_feed_entries_of": (("feed_id", "body"), _feed_entries, S.record(feed_id=_TEXT, pos=_LONG, **{f.name: f.dataType for f in S.ENTRY})),
    "web_sitemap_entries_of": (("url", "body"), _sitemap_entries, S.record(url=_TEXT, pos=_LONG, child=S.BOOLEAN, **S.strings("loc lastmod changefreq"), priority=S.DOUBLE, error=_TEXT)),
    "web_robots_rules_of": (("origin", "body"), _robots_rules, S.record(origin=_TEXT, group_idx=_LONG, agent=_TEXT, rule_idx=_LONG, allow=S.BOOLEAN, path=_TEXT, crawl_delay=S.DOUBLE)),
}


def _spread(name: str) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    takes, rows, kind = TABLES[name]
    types = [to_arrow_type(f.dataType) for f in kind]

    def batch_of(held: list[Row]) -> pa.RecordBatch:
        columns = [pa.array([plain(v, f.dataType) for v in c], t) for c, f, t in zip(zip(*held, strict=True), kind, types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, kind.names)

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held: list[Row] = []
        for a in range(0, batch.num_rows, INPUTS):
            part = batch.slice(a, INPUTS)
            for values in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in takes), strict=True):
                try:
                    for row in rows(*values):
                        held.append(row)
                        if len(held) >= ROWS_OUT:
                            yield batch_of(held)
                            held = []
                except (ValueError, RecursionError):
                    continue  # an input that can't be read gives the rows up to there
        if held:
            yield batch_of(held)

    return spread


def rows_of(inputs: DataFrame, name: str) -> DataFrame:
    """The rows of a function over a DataFrame with the columns that it takes; others are not read."""
    takes, _, kind = TABLES[name]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = _spread(name)
        for batch in batches:
            yield from spread(batch)

    return inputs.select(*takes).mapInArrow(work, kind)


def _function(name: str) -> type:
    class Rows:
        def __init__(self) -> None:
            self.spread = _spread(name)

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield from self.spread(batch)

    return Rows


def register(spark: SparkSession) -> None:
    for name, (_, _, kind) in TABLES.items():
        spark.udtf.register(name, F.arrow_udtf(_function(name), returnType=kind))
