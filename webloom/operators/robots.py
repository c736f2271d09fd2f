"""Robots rules of origins, and what they say about URLs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webloom.cut import small_side, written
from webloom.functions import kernels as K
from webloom.functions.schemas import BOOLEAN, DOUBLE, ROBOTS, STRING, record
from webloom.functions.urls import with_url_parts
from webloom.kernel.robots import RobotsFile

ABSENT = "no robots.txt -- crawl permitted by default"
MOST_BYTES = 512 * 1024
#: URLs of an origin that one task judges; more are dealt to several, each with the origin's file.
URLS_OF_TASK = 200_000


def files(responses: DataFrame) -> DataFrame:
    """origin, status, groups, sitemaps, raw, error of responses (origin, status, body), one for each origin. The first MOST_BYTES count."""
    bytes_ = F.substring(F.coalesce("body", F.lit("")).cast("binary"), 1, MOST_BYTES)
    # A letter that the end cuts in two becomes a replacement character.
    text = F.when(F.col("status").between(200, 299), F.make_valid_utf8(bytes_.cast("string")))
    rows = responses.select("origin", "status", text.alias("raw"), K.parse_robots(text).alias("r"))
    failed = F.when(~F.col("status").between(200, 299) & (F.col("status") != 404), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return rows.select("origin", "status", F.col("r.value.groups").alias("groups"), F.col("r.value.sitemaps").alias("sitemaps"), "raw", F.coalesce(failed, F.col("r.error")).alias("error"))


def rules(robots: DataFrame) -> DataFrame:
    """origin, group_idx, agent, rule_idx, allow, path, crawl_delay: the rules of files, spread out."""
    groups = robots.select("origin", F.posexplode("groups").alias("group_idx", "g"))
    agents = groups.select("origin", "group_idx", F.explode("g.agents").alias("agent"), "g")
    return agents.select("origin", "group_idx", "agent", F.posexplode("g.rules").alias("rule_idx", "r"), F.col("g.crawl_delay").alias("crawl_delay")).select(
        "origin", F.col("group_idx").cast("long").alias("group_idx"), "agent", F.col("rule_idx").cast("long").alias("rule_idx"), "r.allow", "r.path", "crawl_delay"
    )


_JUDGED = record(allow=BOOLEAN, path=STRING, crawl_delay=DOUBLE)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of origin, each origin's file before its URLs: the file is compiled once, and forgotten when the next one begins."""
    arrow = to_arrow_type(_JUDGED)
    origin, file = None, RobotsFile(None)
    for batch in batches:
        n, rows = batch.num_rows, []
        names, paths, agents = (batch.column(c).to_pylist() for c in ("origin", "path", "agent"))
        groups, keep = batch.column("groups"), []
        for i in range(n):
            if paths[i] is None:
                origin, file = names[i], RobotsFile(groups[i].as_py())
                continue
            if names[i] != origin:
                origin, file = names[i], RobotsFile(None)
            keep.append(i)
            rows.append(file.verdict(agents[i] or "", paths[i]))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("key", "origin", "path", "agent")), pa.array(rows, arrow)], ["key", "origin", "path", "agent", "rule"])


def _by_tries(parts: DataFrame, robots: DataFrame, urls_of_task: int) -> DataFrame:
    """parts (key, origin, path, agent) with rule. One shuffle of the parts; an origin with very many of them is several tasks' work."""
    many = parts.where("origin is not null").groupBy("origin").count().where(F.col("count") > urls_of_task)
    shares = small_side(written(many.select("origin", F.ceil(F.col("count") / urls_of_task).cast("int").alias("shares")), "shares"))
    share = F.pmod(F.xxhash64("key"), F.coalesce("shares", F.lit(1))).cast("int")
    asked = parts.join(shares, "origin", "left").select("origin", share.alias("share"), F.lit(True).alias("asks"), "key", "path", "agent", F.lit(None).cast(ROBOTS["groups"].dataType).alias("groups"))
    # URLs without an origin meet no file: they stay apart by their keys.
    asked = asked.withColumn("share", F.when(F.col("origin").isNull(), F.pmod(F.xxhash64("key"), F.lit(1 << 20)).cast("int")).otherwise(F.col("share")))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))
    files = robots.where("origin is not null").join(shares, "origin", "left").select("origin", every.alias("share"), F.lit(False).alias("asks"), F.lit(None).cast(parts.schema["key"].dataType).alias("key"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("agent"), "groups")
    rows = asked.unionByName(files).repartition("origin", "share").sortWithinPartitions("origin", "share", "asks")
    schema = T.StructType([*parts.select("key", "origin", "path", "agent").schema.fields, T.StructField("rule", _JUDGED)])
    return rows.mapInArrow(_judge, schema)


def verdicts(urls: DataFrame, robots: DataFrame, user_agent: str | Column = "*", urls_of_task: int = URLS_OF_TASK) -> DataFrame:
    """For urls (page_id, url): origin, robots_url, status, user_agent, path, allowed, matched_rule, crawl_delay, note, error.

    ``user_agent`` is one for all, or a column of urls. Origins without a file, or with one that isn't found, allow everything. A file's
    groups and rules are compiled once for all URLs of its origin, so that a URL's cost doesn't grow with the rules. The file's text and
    sitemaps are an origin's and stay in ``files``; ``with_files`` adds them to pages.
    """
    agent = F.lit(user_agent) if isinstance(user_agent, str) else user_agent
    parts = with_url_parts(urls.select(F.col("page_id").alias("key"), agent.cast("string").alias("agent"), "url"), "url", "u")
    parts = written(parts.select("key", F.col("u.origin").alias("origin"), F.coalesce(F.concat("u.pathname", "u.search"), F.lit("")).alias("path"), "agent"), "urls")
    judged = _by_tries(parts, robots.select("origin", "groups"), urls_of_task)
    rows = judged.join(robots.select("origin", "status", "error"), "origin", "left")
    absent = F.col("status").isNull() | (F.col("status") == 404)
    return rows.select(
        F.col("key").alias("page_id"),
        "origin",
        F.concat("origin", F.lit("/robots.txt")).alias("robots_url"),
        "status",
        F.col("agent").alias("user_agent"),
        F.when(F.col("origin").isNotNull(), F.col("path")).alias("path"),
        F.when(F.col("error").isNull(), F.coalesce("rule.allow", F.lit(True))).alias("allowed"),
        F.concat(F.when(F.col("rule.allow"), "Allow: ").otherwise("Disallow: "), "rule.path").alias("matched_rule"),
        "rule.crawl_delay",
        F.when(absent, ABSENT).alias("note"),
        "error",
    )


def with_files(verdicts_: DataFrame, robots: DataFrame) -> DataFrame:
    """verdicts with the sitemaps and the text of each page's file."""
    return verdicts_.join(robots.select("origin", "sitemaps", F.col("raw").alias("raw_robots_text")), "origin", "left")
