"""Sitemap crawls over captured responses, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.cut import cut
from webloom.functions import kernels as K
from webloom.functions.tables import rows_of


def parsed(responses: DataFrame) -> DataFrame:
    """url, status, urls, child_sitemaps, error of responses (url, status, body binary)."""
    ok = F.col("status").between(200, 299)
    rows = responses.select("url", "status", "body", K.parse_sitemap(F.when(ok, F.col("body"))).alias("r"))
    http = F.when(~ok, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    empty = F.when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, "empty body")
    failed = F.when(F.col("r.error").isNotNull(), F.concat(F.lit("parse failed: "), "r.error"))
    return rows.select("url", "status", F.col("r.value.urls").alias("urls"), F.col("r.value.child_sitemaps").alias("child_sitemaps"), F.coalesce(http, empty, failed).alias("error"))


def entries(responses: DataFrame) -> DataFrame:
    """url, pos, child, loc, lastmod, changefreq, priority, error of responses (url, status, body binary): entries as they are read.

    A sitemap never is one row, however large it is; ``pos`` counts URLs and child sitemaps apart. Entries before the place where a body can't be read on
    are kept, and a row without loc says why. Responses without a body or of another status than success give such a row alone.
    """
    ok = F.col("status").between(200, 299)
    rows = rows_of(responses.where(ok & (F.octet_length("body") > 0)), "web_sitemap_entries_of")
    none = responses.where(~F.coalesce(ok & (F.octet_length("body") > 0), F.lit(False)))
    why = F.when(~ok, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).otherwise("empty body")
    return rows.unionByName(none.select("url", why.alias("error")), allowMissingColumns=True)


def crawl(seeds: DataFrame, responses: DataFrame, max_depth: int = 1, max_urls: int | None = 5000) -> dict[str, DataFrame]:
    """From seeds (crawl_id, url): ``visited``, ``urls``, ``children``, ``warnings`` and ``summary`` of each crawl.

    Each level joins the sitemaps to visit with the responses, of which only these are parsed, and its children that weren't
    seen, in order of discovery, are the next. A crawl that has max_urls goes to no further level; URLs are not made unique. With None
    for max_urls all URLs are taken.
    The driver only counts the levels.
    """
    if not 0 <= max_depth <= 3 or max_urls is not None and not 1 <= max_urls <= 50_000:
        raise ValueError("max_depth is 0 to 3, max_urls 1 to 50000, or None")
    queue = seeds.select("crawl_id", "url", F.array(F.lit(0)).alias("place"), F.lit(0).alias("depth"))
    levels: list[DataFrame] = []
    for depth in range(max_depth + 1):
        maps = parsed(responses.join(queue.select("url").distinct(), "url", "left_semi")).select(F.col("url").alias("of"), "status", "urls", "child_sitemaps", "error")
        found = queue.join(maps, F.col("url") == F.col("of"), "left").drop("of")
        found = cut(found.withColumn("error", F.when(F.col("status").isNull(), F.lit("no response")).otherwise(F.col("error"))))
        levels.append(found)
        if depth == max_depth:
            break
        seen = reduce(DataFrame.unionByName, (x.select("crawl_id", "url") for x in levels)).distinct()
        children = found.select("crawl_id", "place", F.posexplode("child_sitemaps").alias("i", "url")).select("crawl_id", "url", F.array_append("place", F.col("i")).alias("place"))
        first = children.groupBy("crawl_id", "url").agg(F.min("place").alias("place"))
        unseen = first.join(seen, ["crawl_id", "url"], "left_anti")
        if max_urls is not None:
            gathered = reduce(DataFrame.unionByName, (x.select("crawl_id", F.size("urls").alias("n")) for x in levels)).groupBy("crawl_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("n"))
            open_ = gathered.where(F.coalesce("n", F.lit(0)) < max_urls).select("crawl_id")
            unseen = unseen.join(open_, "crawl_id", "left_semi")
        queue = cut(unseen.withColumn("depth", F.lit(depth + 1)))
    every = reduce(DataFrame.unionByName, levels)
    # In order: level by level, each as it was found. A sitemap is visited while those before it gave too few URLs.
    order = Window.partitionBy("crawl_id").orderBy("depth", "place")
    taken, gathered, full = F.col("urls"), F.sum(F.coalesce(F.size("urls"), F.lit(0))), F.lit(False)
    before = F.coalesce(F.sum(F.coalesce(F.size("urls"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    visits = every.withColumn("rank", F.row_number().over(order)).withColumn("before", before)
    if max_urls is not None:
        taken, gathered, full = F.slice("urls", 1, F.greatest(F.lit(0), max_urls - F.col("before")).cast("int")), F.least(gathered, F.lit(max_urls)), F.col("url_count") >= max_urls
        visits = visits.where(F.col("before") < max_urls)
    visits = cut(visits)
    visited = visits.select("crawl_id", "rank", "url", "depth", "error")
    urls = (
        visits.select("crawl_id", "rank", "depth", "before", F.col("url").alias("sitemap"), F.posexplode(taken).alias("i", "u"))
        .select("crawl_id", (F.col("before") + F.col("i")).cast("long").alias("pos"), "sitemap", "depth", "u.*")
    )
    children = visits.where(F.col("depth") == max_depth).select("crawl_id", "rank", F.posexplode("child_sitemaps").alias("i", "url"))
    # The first sitemap that fails, with nothing gathered, is the crawl's error; later ones are warnings.
    failed = visits.where("error is not null")
    warnings = failed.where((F.col("rank") > 1) | (F.col("before") > 0)).select("crawl_id", "url", "error")
    summary = visits.groupBy("crawl_id").agg(
        F.sum(F.when(F.col("error").isNull(), 1).otherwise(0)).alias("sitemaps"),
        gathered.cast("long").alias("url_count"),
        F.max(F.when((F.col("rank") == 1), F.col("error"))).alias("error"),
    )
    summary = summary.withColumn("truncated", full)
    return {"visited": visited, "urls": urls, "children": children, "warnings": warnings, "summary": summary}
