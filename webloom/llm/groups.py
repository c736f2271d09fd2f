"""Connected components of a graph that the driver never holds, and links found through lists of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.cut import cut, written

#: Graphs of up to so many edges (5 MB) are one task's work; larger ones take rounds of joins, with the same result.
EDGES_IN_ONE_TASK = 300_000
#: Lists of up to so many members are compared in pairs; longer ones by narrower keys.
CROWD = 256


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "label"])


def components(edges: DataFrame, in_one_task: int = EDGES_IN_ONE_TASK) -> DataFrame:
    """node, label for every node of edges (a, b) that isn't its component's least node, which is the label.

    Large graphs: alternating large and small stars. Minima are summed up before the shuffle, and edges meet them in joins
    that Spark can split; no group is collected.
    """
    kept = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if kept.count() <= in_one_task:
        return cut(kept.coalesce(1).mapInArrow(_in_one_task, "node long, label long"))
    before = None
    while True:
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            return kept.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now


def link_lists(
    lists: DataFrame,
    labels: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    fits: Column,
    refined: Callable[[DataFrame], DataFrame] | None = None,
    carry: tuple[str, ...] = (),
    first: tuple[str, ...] = (),
    central: tuple[str, ...] = (),
    sift: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    rounds: int = 1,
    crowd: int = CROWD,
    detail: tuple[DataFrame, Column] | None = None,
) -> DataFrame:
    """labels (node, label), extended by all verified links between nodes that share a key of lists (key, sid, lookup, *carry).

    A row is posted under its key, or a lookup; two lookups need not meet. In a star round each list offers one member to
    those of other components, and each node tries the offer that it meets most often: a group of near copies costs its size.
    Offers are the first by ``first``, then, in the first round, by ``central``, later in an order that changes. Of the lists that still span
    components, those with up to ``crowd`` posted members are compared in pairs, so a member meets ``crowd`` others at most. The
    rows (key, part, sid, lookup, *carry) of the others go to ``refined``, which finds candidate pairs (a, b) for all links among
    them by narrower keys; without it they are compared in pairs too. ``fits`` judges a pair within a list by the carried columns, the other's under ``other_``; ``sift`` may
    drop pairs (a, b) that can't be linked. ``detail`` has further columns of nodes (sid, ...), and a further judgement by these, for
    the comparison in pairs.
    """
    tried = None
    names = ["part", "sid", *carry]
    apart = F.col("part") != F.col("other_part")
    for k in range(rounds + 1):
        placed = lists.join(labels, F.col("sid") == F.col("node"), "left").select("key", "sid", "lookup", *carry, F.coalesce("label", "sid").alias("part"))
        if k:  # lists that lie in one component have nothing more to tell
            placed = spanning(placed)
        crowded = None
        if k < rounds:
            turn = F.struct(*central) if central and not k else F.xxhash64("sid", F.lit(k))
            offered = placed.groupBy("key").agg(F.min(F.struct(*first, turn.alias("turn"), F.struct(*names).alias("m"))).alias("f"))
            other = offered.select("key", *(F.col(f"f.m.{n}").alias(f"other_{n}") for n in names))
            met = placed.join(other, "key").where(apart & fits).groupBy("sid", "other_sid").agg(F.count("*").alias("shared"))
            met = met.groupBy("sid").agg(F.max(F.struct("shared", "other_sid"))["other_sid"].alias("other_sid"))
            pairs = met.select(F.least("sid", "other_sid").alias("a"), F.greatest("sid", "other_sid").alias("b")).distinct()
        else:
            if refined is not None:
                placed = written(placed, "apart")
                crowded = placed.where(F.col("posted") > crowd).drop("posted")
                placed = placed.where(F.col("posted") <= crowd)
            if detail is None:
                pairs = paired(placed, fits, carry)
            else:
                pairs = paired(placed.join(detail[0], "sid"), fits & detail[1], (*carry, *(c for c in detail[0].columns if c != "sid")))
            if crowded is not None and crowded.limit(1).count():
                pairs = pairs.unionByName(refined(crowded)).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(sift(pairs), "tried")
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(verified(pairs)))
    return labels


def spanning(lists: DataFrame) -> DataFrame:
    """The rows of lists (key, sid, part, lookup, ...) whose key spans components and has ``posted`` members, one at least."""
    keys = lists.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.when(~F.col("lookup"), True)).alias("posted"))
    return lists.join(keys.where("low < high and posted > 0").select("key", "posted"), "key")


def paired(lists: DataFrame, fits: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of a posted member and another of a list (key, sid, part, lookup, *carry) that lie in different components and fit."""
    other = lists.where("not lookup").select("key", *(F.col(n).alias(f"other_{n}") for n in ("sid", "part", *carry)))
    once = F.col("lookup") | (F.col("sid") < F.col("other_sid"))  # two posted members meet once
    met = lists.join(other, "key").where((F.col("part") != F.col("other_part")) & once & fits)
    return met.select(F.least("sid", "other_sid").alias("a"), F.greatest("sid", "other_sid").alias("b")).distinct()


def starred(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of the least posted member of each list (key, sid, part, lookup) with its members in other components."""
    offered = lists.groupBy("key").agg(F.min(F.when(~F.col("lookup"), F.struct("sid", "part"))).alias("o")).where("o is not null").select("key", "o")
    met = lists.join(offered, "key").where("part <> o.part")
    return met.select(F.least("sid", "o.sid").alias("a"), F.greatest("sid", "o.sid").alias("b")).distinct()
