"""Operators over pages (page_id, url, html): one row in, one or many out. Only the columns named are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import kernels as K
from webloom.functions import text as X

EMPTY = "empty body"


def _error(found: str, empty: str = EMPTY) -> Column:
    return F.when(F.coalesce(F.col("html"), F.lit("")) == "", empty).otherwise(F.col(found)["error"])


def plain_text(pages: DataFrame) -> DataFrame:
    """page_id, text, error; the chain of replacements runs in generated code."""
    return pages.select("page_id", X.strip_html(F.col("html")).alias("text"), F.when(F.coalesce(F.col("html"), F.lit("")) == "", "response body was empty").alias("error"))


def text_stats(pages: DataFrame) -> DataFrame:
    text = plain_text(pages)
    return text.select("page_id", X.word_count(F.col("text")).alias("n_words"), F.length("text").cast("long").alias("n_chars"))


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", K.page_title("html").alias("r")).select("page_id", F.col("r.value").alias("title"), F.col("r.error").alias("error"))


def markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown, error: the whole document."""
    rows = pages.select("page_id", "html", K.to_markdown("html").alias("r"))
    failed = F.when(F.col("r.error").isNotNull(), F.concat(F.lit("HTML-to-markdown conversion failed: "), "r.error"))
    return rows.select("page_id", F.col("r.value").alias("markdown"), F.coalesce(F.when(F.coalesce("html", F.lit("")) == "", "response body was empty"), failed).alias("error"))


def main_content(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "html", K.main_content("html").alias("r"))
    return rows.select("page_id", F.col("r.value.strategy").alias("strategy"), F.col("r.value.content").alias("content"), _error("r").alias("error"))


def first_elements(pages: DataFrame, name: str, attribute: str, value: str) -> DataFrame:
    """page_id, content, error: what the first outermost element of a name holds whose attribute has the value; null without one."""
    rows = pages.select("page_id", "html", K.first_element("html", F.lit(name), F.lit(attribute), F.lit(value)).alias("r"))
    return rows.select("page_id", F.col("r.value").alias("content"), _error("r").alias("error"))


def articles(pages: DataFrame) -> DataFrame:
    """page_id, url, title, byline, word_count, markdown, error: the main content as an article."""
    rows = pages.select("page_id", "html", K.read_article("html", "url").alias("r"))
    return rows.select("page_id", "r.value.*", _error("r").alias("error"))


def metadata(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "html", K.page_meta("html", "url").alias("r"))
    return rows.select("page_id", "r.value.*", _error("r").alias("error"))


def link_lists(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "html", K.extract_links("html", "url").alias("r"))
    return rows.select("page_id", F.col("r.value").alias("links"), _error("r").alias("error"))


def _first_of_href(links: Column) -> Column:
    """Links whose href no earlier one has, in linear time: positions by href, then the least of each."""
    at = F.transform(links, lambda x, i: F.struct(x["href"].alias("href"), i.alias("i")))
    ordered = F.array_sort(at)
    firsts = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["href"] != x["href"]))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: x["i"])), lambda i: F.get(links, i))


def links(pages: DataFrame, dedupe: bool = True, kind: str = "all", limit: int | None = 1000) -> DataFrame:
    """page_id, pos, href, text, rel, title, type, link_count, truncated: filtered by type, first of each href, at most limit.

    Everything per page happens inside its array, before it is spread, so no row is shuffled.
    """
    if kind not in ("all", "internal", "external"):
        raise ValueError(f"kind is all, internal or external, not {kind}")
    if limit is not None and not 1 <= limit <= 10_000:
        raise ValueError("limit is 1 to 10000")
    found = F.col("links") if kind == "all" else F.filter("links", lambda x: x["type"] == kind)
    rows = link_lists(pages).select("page_id", found.alias("links"))
    if dedupe:
        rows = rows.select("page_id", _first_of_href(F.col("links")).alias("links"))
    capped = F.slice("links", 1, limit) if limit is not None else F.col("links")
    more = F.size("links") > limit if limit is not None else F.lit(False)
    rows = rows.select("page_id", capped.alias("links"), more.alias("truncated"))
    return rows.select("page_id", F.size("links").cast("long").alias("link_count"), "truncated", F.posexplode("links").alias("pos", "l")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "l.*", "link_count", "truncated"
    )


def meta_values(pages: DataFrame, kind: str = "og") -> DataFrame:
    """page_id, key, first, n: first value and number of values of each og, twitter or article key."""
    rows = metadata(pages).select("page_id", F.explode(kind).alias("key", "first"), F.col(f"{kind}_all").alias("several"))
    return rows.select("page_id", "key", "first", F.coalesce(F.size(F.try_element_at("several", "key")), F.lit(1)).cast("long").alias("n"))
