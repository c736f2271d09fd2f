"""The prefix trie against a plain one, by dictionaries of prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from oracle import SMALL, assert_same, connection

from webloom.cut import clear_written
from webloom.llm import prefix_trie, queries


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    convs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, x in convs.items():
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    ended = lambda n, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(n)))).encode()).hexdigest()
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], ended(n, m)) for n, m in nodes.items())


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string")
    return sorted(tuple(-1 if r[n] is None else r[n] for n in NAMES) for r in prefix_trie.conversation_trie(frame).collect())


def test_sql(spark):
    assert_same(queries.QUERIES["op13_prefix_trie"](spark, SMALL).toPandas(), connection().sql(queries.ORACLES["op13_prefix_trie"]).df())
    clear_written(spark)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    """Few different turns, so that prefixes branch everywhere; lenders that are absent, ids below zero, chains below chains."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-250, 700), 120):
        n = r.choice([0, 1, 2, 5, 9, 14])
        rows += [(c, t, r.choice(["user", "user", None]), r.choice(["a", "bb", "é😀", None])) for t in range(n)]
    assert found(spark, rows) == plain(rows)


def test_stairs(spark):
    """Each conversation goes one turn further than the last: a tree as high as it can be; then equal ones, of which one owns all."""
    rows = [(100 * k + 107, t, "user", f"t{t}") for k in range(20) for t in range(6, 6 + k)]
    rows = [(c, t - 6, role, text) for c, t, role, text in rows] + [(c, t, "user", f"t{t}") for c in (5000, 5001, 5002) for t in range(12)]
    assert found(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "gone"), (100, None, "user", "first"), (100, 0, None, None), (100, 0, "user", ""), (100, 1, "user", "x" * 300_000), (100, 1, "user", "x" * 300_000), (7, None, None, None)]
    rows += [(101, t, "user", text) for t, text in enumerate(["first", "", "", "x"])] + [(c, 0, "user", "only") for c in range(200, 240)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:1]) == []


def test_conversations_without_turns(spark):
    """Those whose turns are fewer than their borrowed ones, with no lender: members of the root only."""
    short = [c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    rows = [(c, 0, "user", "a") for c in short]
    assert found(spark, rows) == plain(rows)
    assert [x[:7] for x in plain(rows)] == [(short[0], 0, -1, 5, 0, 1, 0)]


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, t, "user", f"same {t}") for c in [*range(-30, 30), *range(600, 690)] for t in range(8)]
    assert found(spark, rows) == plain(rows)


def test_a_long_conversation_is_several_parts(spark):
    from pyspark.sql import functions as F

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # these parts would be put together, so small are they
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("conv"), "id")
    placed = prefix_trie._placed(rows, "conv", "id")
    assert placed.where("conv = 1").select("part").distinct().count() > 1
    summed = prefix_trie.running(placed, "conv", {"n": (F.lit(1), "sum"), "x": (F.col("id"), "xor")}).where("conv = 1").orderBy("id").collect()
    assert [r.n for r in summed] == list(range(1, len(summed) + 1))
    from_end = prefix_trie.running(placed, "conv", {"n": (F.lit(1), "sum")}, from_end=True).where("conv = 1").orderBy("id").collect()
    assert [r.n for r in from_end] == list(range(len(from_end), 0, -1))
    spark.conf.unset(key)
