"""URL filtering: a rule list first, then association rules mined by FP-growth from labelled URLs.

A URL's items are its host labels, path segments (digits as ``#``), query keys and scheme. Rules "items -> block" or
"items -> allow" that reach the support, the confidence and the lift over the verdict's share are kept, less those that a
rule of fewer of their items and no lower confidence implies. Each is posted under its rarest item; URLs look their items up
there and the posted rule is then verified. Of the rules that fit a URL the one of the highest lift decides, then the most
confident, then the best supported, then the last by its items.

Very long URLs: whole, like any other. Null URL, or one without ``://``: host and path are empty and it has no items, so the default verdict holds. Ties and
repeated rows: every row is judged, equal URLs alike. Empty tables: no rows, or no mined rules. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.cut import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: Mined rules up to this number and of so many bytes are one value of the plan, in so many lists; more are joined by a shuffle.
BROADCAST_RULES, BROADCAST_BYTES, BUCKETS = 20_000, 4 << 20, 1024


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def items_of(url: Column) -> Column:
    """The URL's distinct items, sorted."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 3)
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)
    segments = F.split(F.regexp_replace(F.translate(path, UPPER, LOWER), "[0-9]+", "#"), "/")
    keys = F.transform(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(named("scheme", F.array(scheme)), named("host", F.split(host, r"\.")), named("path", segments), named("key", keys))))


def listed_rule(url: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (as ``host/path``) that fits the URL, and its verdict; nulls where none fits."""
    host, path = host_of(url), path_of(url)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decides, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, below = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decides).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, min_support: float, min_confidence: float, min_count: int = 10, min_lift: float = 1.0) -> DataFrame:
    """Rules (items, verdict, lift, confidence, support, rarest) from labelled (url, verdict) rows; null labels are left out.

    A rule needs both the share min_support and the number min_count of rows that have its items and its verdict, the
    confidence, and a confidence of min_lift times the verdict's share of all rows.
    """
    spark = labelled.sparkSession
    rows = labelled.where("verdict is not null").select(F.array_append(items_of(F.col("url")), F.concat(F.lit("verdict:"), "verdict")).alias("items"))
    support = min(1.0, max(min_support, min_count / max(1, rows.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(rows)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    verdict = F.col("consequent")[0]
    rules = model.associationRules.where(verdict.startswith("verdict:") & (F.col("lift") >= min_lift))
    rules = written(rules.select(F.array_sort("antecedent").alias("items"), F.substring(verdict, 9, 1000).alias("verdict"), "lift", "confidence", "support"), "url-rules")
    # A rule is implied by another one of fewer of its items and no less confidence: each looks up all of its parts.
    named = lambda items: F.xxhash64(items, "verdict")
    ids = rules.withColumn("id", named("items"))
    masks = F.sequence(F.lit(1).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size("items")) - 2)
    some = rules.where(F.size("items") > 1).select("items", "verdict", "confidence", F.explode(masks).alias("mask"))
    part = F.filter("items", lambda x, i: F.getbit("mask", i) == 1)
    known = ids.select(F.col("id").alias("part_id"), F.col("confidence").alias("part_confidence"))
    implied = (
        some.select(named("items").alias("id"), "confidence", named(part).alias("part_id")).join(known, "part_id").where("part_confidence >= confidence").select("id").distinct()
    )
    kept = ids.join(implied, "id", "left_anti")
    rarest = kept.select("id", F.explode("items").alias("item")).join(single, "item").groupBy("id").agg(F.min(F.struct("freq", "item"))["item"].alias("rarest"))
    return kept.join(rarest, "id").select("items", "verdict", "lift", "confidence", "support", "rarest")


def _fits(rule: Column, items: Column | str) -> Column:
    return F.size(F.array_except(rule, items)) == 0


def _inverted(index: DataFrame) -> Column:
    """The rules as an array of BUCKETS lists, by a hash of the rarest item: one value, computed once, of at most BROADCAST_BYTES."""
    rule = F.struct("rarest", "lift", "confidence", "support", "items", "verdict")
    lists = index.groupBy(F.pmod(F.xxhash64("rarest"), F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.collect_list(rule).alias("rules"))
    by_bucket = F.map_from_entries(F.collect_list(F.struct("bucket", "rules")))
    return lists.agg(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.try_element_at(by_bucket, b)).alias("index")).scalar()


def judge(pages: DataFrame, listed: list[tuple[str, str]], mined: DataFrame, default: str = "allow", most_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_items, lift, confidence for every row of pages (page_id, url).

    Up to most_rules mined rules (and BROADCAST_BYTES of them) are one value that every row looks its items up in: no shuffle,
    so no host is hot. More rules are joined with the distinct sets of items.
    """
    url = F.col("url")
    rule, by_list = listed_rule(url, listed)
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), rule.alias("rule"), by_list.alias("by_list"), items_of(url).alias("url_items"))
    index = written(mined, "url-index")
    n, size = index.agg(F.count("*"), F.sum(F.length(F.array_join("items", " ")) + 64)).collect()[0]
    ranked = lambda r: F.struct(*(r[c].alias(c) for c in ("lift", "confidence", "support", "items", "verdict")))
    if not n:
        best = F.lit(None).cast("struct<lift:double,confidence:double,support:double,items:array<string>,verdict:string>")
        judged = rows.withColumn("best", best)
    elif n <= most_rules and size <= BROADCAST_BYTES:
        of_item = lambda i: F.filter(
            F.coalesce(F.get("index", F.pmod(F.xxhash64(i), F.lit(BUCKETS)).cast("int")), F.array()), lambda r: (r["rarest"] == i) & _fits(r["items"], "url_items")
        )
        fitting = F.flatten(F.transform("url_items", of_item))
        judged = rows.withColumn("index", _inverted(index)).withColumn("best", F.when(F.col("by_list").isNull(), F.array_max(F.transform(fitting, ranked))))
    else:
        # Each set of items is looked up once, however many rows have it.
        sets = rows.where("by_list is null").select("url_items").distinct()
        found = sets.select("url_items", F.explode("url_items").alias("rarest")).join(index, "rarest").where(_fits(F.col("items"), "url_items"))
        found = found.groupBy("url_items").agg(F.max(F.struct("lift", "confidence", "support", "items", "verdict")).alias("best"))
        judged = rows.join(written(found, "url-verdicts"), "url_items", "left").withColumn("best", F.when(F.col("by_list").isNull(), F.col("best")))
    best = F.col("best")
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_list", best["verdict"], F.lit(default)).alias("verdict"),
        F.array_join(best["items"], " ").alias("mined_items"),
        best["lift"].alias("lift"),
        best["confidence"].alias("confidence"),
    )
