"""Which addresses and URLs may be reached, set by set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.cut import cut, written
from webloom.functions import kernels as K
from webloom.functions.net import ipv4_refused, ipv4_to_long
from webloom.functions.urls import is_plain
from webloom.kernel.net import REFUSED_V4


def refused_ranges(spark: SparkSession) -> DataFrame:
    """low, high, range: the refused IPv4 ranges, a fixed table."""
    rows = [(int(n.network_address), int(n.broadcast_address), str(n)) for n in REFUSED_V4]
    return spark.createDataFrame(rows, "low long, high long, range string")


def addresses_with_range(addresses: DataFrame) -> DataFrame:
    """ip, refused, range of addresses (ip): the narrowest refused range, by a join with the fixed table."""
    ranges = F.broadcast(refused_ranges(addresses.sparkSession))
    n = addresses.select("ip", ipv4_to_long(F.col("ip")).alias("n"))
    hit = n.distinct().join(ranges, F.col("n").between(F.col("low"), F.col("high")))
    best = hit.groupBy("ip").agg(F.min(F.struct((F.col("high") - F.col("low")).alias("width"), "range"))["range"].alias("range"))
    return n.join(best, "ip", "left").select("ip", F.when(F.col("n").isNotNull(), F.col("range").isNotNull()).alias("refused"), "range")


def _numbered(addresses: DataFrame) -> DataFrame:
    """ip, family, high, low of each distinct address; only what isn't a dotted address goes to Python."""
    n = ipv4_to_long(F.col("ip"))
    tasks = int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = addresses.select("ip").repartition(tasks, "ip").distinct().select("ip", n.alias("n"), K.address_number(F.when(n.isNull(), F.col("ip")))["value"].alias("v"))
    dotted = F.struct(F.lit(4).alias("family"), F.shiftleft("n", 32).alias("high"), F.lit(0).cast("long").alias("low"))
    return rows.select("ip", F.when(F.col("n").isNotNull(), dotted).otherwise(F.col("v")).alias("v")).select("ip", "v.*")


def address_owners(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every row of addresses (ip) with range, the narrowest of ranges (range) that holds it; of equally wide ones the first by its text; else null.

    Where ranges has a column name, that is given instead of the range's text, and orders equally wide ones.

    A range is an address, a network or two addresses, of either family. It is cut into prefixes; an address is looked up under its own prefixes,
    of those lengths alone that occur (162 at most), by equality: no two tables are compared by bounds. Ranges and addresses that can't be
    read match nothing.
    """
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = ranges.select("range", F.col("name" if "name" in ranges.columns else "range").alias("name")).repartition(tasks, "range")
    pieces = written(named.select("name", F.explode(K.range_pieces("range")["value"]).alias("p")).select("name", "p.*"), "ranges")
    # The same piece of several ranges: the narrowest range counts.
    pieces = pieces.groupBy("family", "length", "high", "low").agg(F.min(F.struct("width", "name")).alias("best"))
    lengths = {4: [], 6: []}
    for r in pieces.select("family", "length").distinct().collect():
        lengths[r["family"]].append(r["length"])
    of = lambda family: F.array(*map(F.lit, sorted(lengths[family]))).cast("array<int>")
    asked = _numbered(addresses).select("*", F.explode(F.when(F.col("family") == 4, of(4)).otherwise(of(6))).alias("length"))
    high = F.expr("case when length >= 64 then high when length = 0 then 0L else high & shiftleft(-1L, 64 - length) end")
    low = F.expr("case when length = 128 then low when length <= 64 then 0L else low & shiftleft(-1L, 128 - length) end")
    found = asked.select("ip", "family", "length", high.alias("high"), low.alias("low")).join(pieces, ["family", "length", "high", "low"])
    best = found.groupBy("ip").agg(F.min("best")["name"].alias("range"))
    return addresses.join(best, "ip", "left")


def address_verdicts(addresses: DataFrame) -> DataFrame:
    """ip, ok, reason of addresses (ip), IPv4 or IPv6; dotted ones that pass never leave generated code for Python's reasons."""
    rows = addresses.select("ip", ipv4_refused(F.col("ip")).alias("v4"))
    why = K.address_refusal(F.when(F.col("v4").isNull() | F.col("v4"), F.col("ip")))
    return rows.select("ip", why.alias("r")).select("ip", (F.col("r.value").isNull() & F.col("ip").isNotNull()).alias("ok"), F.col("r.value").alias("reason"))


def url_verdicts(urls: DataFrame, allow_private: bool = False) -> DataFrame:
    """All columns of urls, ok and reason for its column url. Plain URLs of names are let pass in generated code; only others go to Python."""
    url = F.col("url")
    named = is_plain(url) & ~url.rlike(r"^https?://[^/?#:]*\.localhost(?:[/?#:]|\z)")
    kept = [F.col(f"`{c}`") for c in urls.columns]
    passed = urls.where(named).select(*kept, F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    rows = urls.where(~named).withColumn("verdict of url", K.url_verdict("url", F.lit(allow_private)))
    return passed.union(rows.select(*kept, F.col("`verdict of url`.value.ok").alias("ok"), F.col("`verdict of url`.value.reason").alias("reason")))


def host_answers(answers: DataFrame) -> DataFrame:
    """host, refused, reason of answers (host, pos, ip): any refused address refuses the host, the first gives the reason."""
    rows = answers.select("host", "pos", "ip", K.address_refusal("ip").alias("r"))
    first = F.min(F.when(F.col("r.value").isNotNull(), F.struct("pos", "ip", F.col("r.value").alias("why"))))
    rows = rows.groupBy("host").agg(first.alias("f"), F.count("ip").alias("n"))
    none = F.concat(F.lit("DNS: "), F.col("host"), F.lit(" returned no addresses"))
    reason = F.when(F.col("n") == 0, none).when(F.col("f").isNotNull(), F.concat(F.lit("DNS: "), F.col("host"), F.lit(" -> "), F.col("f.ip"), F.lit(" -- "), F.col("f.why")))
    return rows.select("host", reason.isNotNull().alias("refused"), reason.alias("reason"))


def follow_redirects(requests: DataFrame, captured: DataFrame, max_redirects: int = 5) -> DataFrame:
    """request_id, url (final), status, hops, error of requests (request_id, url) over captured (url, status, location).

    Each round joins what is still under way with the captured responses; there are at most max_redirects + 1.
    """
    pages = captured.select(F.col("url").alias("of"), "status", "location")
    way, done = requests.select("request_id", "url", F.lit(0).cast("long").alias("hops")), []
    for _ in range(max_redirects + 1):
        met = cut(way.join(pages, F.col("url") == F.col("of"), "left"))
        goes_on = F.col("status").between(300, 399) & F.col("location").isNotNull()
        over = goes_on & (F.col("hops") >= max_redirects)
        error = F.when(F.col("status").isNull(), "no response").when(over, f"exceeded {max_redirects} redirects")
        done.append(met.where(~F.coalesce(goes_on, F.lit(False)) | over).select("request_id", "url", F.when(error.isNull(), F.col("status")).otherwise(0).alias("status"), "hops", error.alias("error")))
        onward = met.where(goes_on & ~over).select("request_id", "hops", K.resolve_url("location", "url").alias("next"))
        way = onward.select("request_id", F.col("next.value").alias("url"), (F.col("hops") + 1).alias("hops"))
    return reduce(DataFrame.unionByName, done)
