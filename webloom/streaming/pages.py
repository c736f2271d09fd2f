"""Streams of pages: the row-wise operators work unchanged; what looks across rows needs a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import kernels as K


def unique_links(pages: DataFrame, watermark: str, seen_at: str = "seen_at") -> DataFrame:
    """Links of a stream of pages (page_id, url, html and an event time), each href of a page once within the watermark."""
    rows = pages.withWatermark(seen_at, watermark).select("page_id", seen_at, K.extract_links("html", "url").alias("r"))
    return rows.select("page_id", seen_at, F.explode("r.value").alias("l")).select("page_id", seen_at, "l.*").dropDuplicatesWithinWatermark(["page_id", "href"])


def links_per_host(pages: DataFrame, window: str, watermark: str, seen_at: str = "seen_at") -> DataFrame:
    """Links per target host and time window, complete once the watermark has passed the window."""
    rows = pages.withWatermark(seen_at, watermark).select(seen_at, K.extract_links("html", "url").alias("r"))
    hosts = rows.select(seen_at, F.explode("r.value").alias("l")).select(seen_at, F.regexp_extract("l.href", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    return hosts.groupBy(F.window(seen_at, window).alias("window"), "host").agg(F.count("*").alias("n"))
