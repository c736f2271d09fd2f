"""Feeds (feed_id, body): parents and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import kernels as K


def feeds(bodies: DataFrame, limit: int = 50) -> DataFrame:
    """feed_id, kind, title, description, link, updated, entry_count (all), truncated, entries (the first), error."""
    if not 1 <= limit <= 500:
        raise ValueError("limit is 1 to 500")
    rows = bodies.select("feed_id", "body", K.parse_feed("body").alias("r"))
    v = F.col("r.value")
    failed = F.when(F.col("r.error").isNotNull(), F.concat(F.lit("feed parse failed: "), "r.error"))
    return rows.select(
        "feed_id",
        *(v[n].alias(n) for n in ("kind", "title", "description", "link", "updated")),
        F.size(v["entries"]).cast("long").alias("entry_count"),
        (F.size(v["entries"]) > limit).alias("truncated"),
        F.slice(v["entries"], 1, limit).alias("entries"),
        F.coalesce(F.when(F.coalesce("body", F.lit("")) == "", "empty body"), failed).alias("error"),
    )


def feed_entries(bodies: DataFrame, limit: int = 50) -> DataFrame:
    """feed_id, pos and the fields of the first entries of each feed, in document order."""
    return feeds(bodies, limit).select("feed_id", F.posexplode("entries").alias("pos", "e")).select("feed_id", F.col("pos").cast("long").alias("pos"), "e.*")
