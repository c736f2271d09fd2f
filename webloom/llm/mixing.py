"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: the weights share ``ratio`` times all tokens; a target stops at ``most`` times its source's size and the excess
goes to the others by weight. Blocks of equal tokens are then seats: each goes to the source with the highest quotient
target / (2 * seats + 1), and in the same way from a source to its shards by their tokens. In a shard, documents lie in
seeded order, one after another, which cuts their tokens into blocks; the quota takes whole passes over the shard, and as many
blocks as are left, those with the first places of a seeded permutation.

Null text: size 0. Null source: a source of its own, last. Null doc_id: ordered by its text. Repeated rows: each is a
document. Ties in the seeded order: by doc_id; equal rows are interchangeable. Very long texts: all their words, over as many blocks. Other columns
are ignored. Empty table: no rows.

The driver holds one row per source and per shard; there are at most MOST_SHARDS shards more than sources.
"""

from __future__ import annotations

import hashlib
import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.cut import cut

WORD = r"[^\x20\x09-\x0D]+"
MOST_SHARDS = 100_000
BROADCAST_ROWS = 20_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_out(total: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares of ``total`` by weight, none above its cap; the excess is shared again by weight."""
    shares, left, weight = [0.0] * len(weights), total, float(sum(weights))
    for i in sorted(range(len(weights)), key=lambda i: (caps[i] / weights[i], i)):
        shares[i] = float(min(caps[i], left * weights[i] / weight))
        left, weight = left - shares[i], weight - weights[i]
    return shares


def sainte_lague(seats: int, votes: list[float], caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 * seats + 1), ties to the first, none above its cap.

    Starts from the rounded shares, which the highest-quotient rule never leaves by more than a few seats, and then moves
    seat by seat; so the work follows the number of parties, not the number of seats.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    top = [min(c, 2**62) for c in caps] if caps else [2**62] * len(votes)
    # A multiplier whose rounded quotas, capped, are near the seats.
    low, high = 0.0, 2.0 * (seats + len(votes)) / min(v for v in votes if v > 0)
    given = lambda x: [min(t, max(0, math.floor(v * x + 0.5))) for v, t in zip(votes, top, strict=True)]
    for _ in range(200):
        mid = (low + high) / 2
        if sum(given(mid)) <= seats:
            low = mid
        else:
            high = mid
    won = given(low)
    left = seats - sum(won)
    heap = [(-v / (2 * n + 1), i) for i, (v, n, t) in enumerate(zip(votes, won, top, strict=True)) if v > 0 and n < t]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        won[i] += 1
        left -= 1
        if won[i] < top[i]:
            heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def by_code_point(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5, most: int = 2, seed: int = 17, block_tokens: int = 1024, shard_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source).

    weights: of the sources by code point, null last, repeating. A block has block_tokens tokens, or fewer where that
    would be over half a percent of the smallest target.
    """
    spark = docs.sparkSession
    rows = cut(
        docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))).alias("place"))
    )
    sources = sorted(((r[0], r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()), key=lambda r: by_code_point(r[0]))
    sizes = [n for _, n in sources]
    total = sum(sizes)
    targets = share_out(ratio * total, [weights[i % len(weights)] for i in range(len(sources))], [most * n for n in sizes])
    least = min((t for t in targets if t > 0), default=1)
    block = max(1, min(block_tokens, int(least / 200)))
    per_shard = max(shard_tokens, -(-total // MOST_SHARDS))
    shards = [max(1, -(-n // per_shard)) for n in sizes]
    quotas = sainte_lague(round(sum(targets) / block), targets, [-(-most * n // block) for n in sizes])

    named = spark.createDataFrame(
        [(s, n, t, k) for (s, n), t, k in zip(sources, targets, shards, strict=True)], "source string, source_size long, target double, shards int"
    ).withColumnRenamed("source", "named")
    named = F.broadcast(named) if len(sources) <= BROADCAST_ROWS else named
    dealt = rows.join(named, F.col("source").eqNullSafe(F.col("named"))).select(
        "doc_id", "source", "size", "place", "source_size", "target", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.col("shards")).cast("int").alias("shard")
    )
    held: dict[str | None, list[tuple[int, int]]] = {}
    for s, k, n in dealt.groupBy("source", "shard").agg(F.sum("size")).collect():
        held.setdefault(s, []).append((k, n))
    plan = []
    for (s, _), quota in zip(sources, quotas, strict=True):
        own = sorted(held.get(s, []))
        for (k, n), q in zip(own, sainte_lague(quota, [n for _, n in own], [-(-most * n // block) for _, n in own]), strict=True):
            passes, rest = divmod(min(q * block, most * n), n) if n else (0, 0)
            plan.append((s, k, passes, *chosen_blocks(seed, s, k, n, block, rest)))
    quota_of = spark.createDataFrame(plan, "planned string, at int, passes long, blocks long, picked long, factor long, shift long")
    quota_of = F.broadcast(quota_of) if len(plan) <= BROADCAST_ROWS else quota_of
    before = Window.partitionBy("source", "shard").orderBy("place", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("to", F.sum("size").over(before)).withColumn("from", F.col("to") - F.col("size"))
    own = placed.join(quota_of, F.col("source").eqNullSafe(F.col("planned")) & (F.col("shard") == F.col("at")))
    at = lambda b: (b * F.col("factor") + F.col("shift")) % F.col("blocks")
    inside = lambda b: F.least("to", (b + 1) * block) - F.greatest("from", b * block)
    touched = F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))
    some = F.aggregate(touched, F.lit(0).cast("long"), lambda total, b: total + F.when(at(b) < F.col("picked"), inside(b)).otherwise(0))
    taken = F.col("passes") * F.col("size") + F.when((F.col("size") > 0) & (F.col("picked") > 0), some).otherwise(0)
    return own.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def chosen_blocks(seed: int, source: str | None, shard: int, tokens: int, block: int, rest: int) -> tuple[int, int, int, int]:
    """(blocks, picked, factor, shift): of a shard's blocks those b are taken for which (b * factor + shift) % blocks < picked.

    The factor has no divisor in common with the number of blocks, so this is a permutation, and as many as picked are taken.
    """
    blocks = max(1, -(-tokens // block))
    drawn = hashlib.sha256(f"{seed}\0{source is None}\0{source}\0{shard}".encode("utf-8", "surrogatepass")).digest()
    factor = 1 + int.from_bytes(drawn[:8], "big") % blocks
    while math.gcd(factor, blocks) > 1:
        factor += 1
    return blocks, min(blocks, round(rest / block)), factor, int.from_bytes(drawn[8:16], "big") % blocks
