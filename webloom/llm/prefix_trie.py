"""Prefix trie of conversations: who shares which first turns, what sharing saves, and where conversations end.

A conversation's first d turns (role, text) are a node; the conversations that begin so are its members, the least of them owns it. A
conversation that owns a node owns all nodes below on its way, so its nodes are one chain, from its first owned depth to its end. This depth is
found by binary search for all conversations at once: a round joins each one's prefix digest in the middle of what is open with the least
conversation of that digest. The owner of the node above a chain is the chain's parent, so chains form a tree, with
a row for each conversation (those that own nothing are chains without nodes). Members, leaves and savings of subtrees are summed up from below by
pointer doubling, as many rounds as the logarithm of the tree's height, and spread over a chain's nodes by running sums.

Digests are two 64-bit sums (exclusive or) of hashes of place, role and text, taken to differ for different prefixes. Turns are put in order over all
conversations at once and numbered by parts, so that a conversation of very many turns is many tasks' work. The ids of those that end in a node are
joined in pieces of PIECE numbers at most and hashed piece after piece.

Conversation c is rebuilt first: the first h turns of conversation c - c % 100, as far as there are, then its own without its first h; h is the
crc32 of its decimal number, modulo 6. Rows without conv_id are not used. Null turn: before the others. Rows that tie on turn: by role, then
text. Null role or text: empty. Repeated rows: repeated turns. Equal conversations: one node has them all. Very long texts:
whole, in one shuffle, and hashes after it. No rows: no rows, and no root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.cut import cut, written

#: Turns that are borrowed at most, conversations that share a lender, ids of a piece.
BORROWED, LENDER, PIECE = 5, 100, 1 << 16
_NODE = ["depth", "d1", "d2"]


def _placed(rows: DataFrame, key: str, *order: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows with their place ``at`` in the order of key and order, and the number ``part`` of their part of it: a key of very many rows has several."""
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return written(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).drop(*drop), "trie-placed")


Running = dict[str, tuple[Column, str]]
_WAYS = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def running(placed: DataFrame, key: str, sums: Running, from_end: bool = False) -> DataFrame:
    """placed with the sums (name: column, way) over a key's rows from its first, or its last, to each row."""
    order = F.desc if from_end else F.asc
    here = Window.partitionBy(key, "part").orderBy(order("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(order("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(key, "part").agg(*(_WAYS[way][0](c).alias(n) for n, (c, way) in sums.items()))
    carried = totals.select(key, "part", *(F.coalesce(_WAYS[way][0](n).over(before), F.lit(0)).alias(f"{n} before") for n, (_, way) in sums.items()))
    rows = placed.select("*", *(_WAYS[way][0](c).over(here).alias(f"{n} here") for n, (c, way) in sums.items())).join(carried, [key, "part"])
    return rows.select(*placed.columns, *(_WAYS[way][1](F.col(f"{n} before"), F.col(f"{n} here")).alias(n) for n, (_, way) in sums.items()))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos from 0, x1, x2, chars) of the rebuilt conversations, and every conversation (conv, length)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    hashed = [F.xxhash64(F.lit(1), "role", "text").alias("x1"), F.xxhash64(F.lit(2), "role", "text").alias("x2"), F.length("text").cast("long").alias("chars")]
    placed = _placed(turns.select("*", *hashed), "conv", "turn", "role", "text", drop=("turn", "role", "text"))
    turns = running(placed, "conv", {"n": (F.lit(1), "sum")}).select("conv", (F.col("n") - 1).alias("i"), "x1", "x2", "chars")
    turns = written(turns, "trie-turns")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (BORROWED + 1)
    lenders = sizes.where(F.col("conv") % LENDER == 0).select(F.col("conv").alias("lender"), F.col("n").alias("lent"))
    convs = sizes.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % LENDER).alias("lender")).join(lenders, "lender", "left")
    convs = convs.select("conv", "lender", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("got"), "n")
    convs = written(convs.select("*", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    own = turns.join(convs.select("conv", "h", "got"), "conv").where("i >= h").select("conv", (F.col("got") + F.col("i") - F.col("h")).alias("pos"), "x1", "x2", "chars")
    heads = turns.where((F.col("conv") % LENDER == 0) & (F.col("i") < BORROWED)).withColumnRenamed("conv", "lender")
    lent = convs.select("conv", "lender", "got").join(heads, "lender").where("i < got").select("conv", F.col("i").alias("pos"), "x1", "x2", "chars")
    return own.unionByName(lent), convs.select("conv", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth from 1, d1, d2, chars: the digests of each conversation's first turns, and the length of the last of these."""
    keyed = turns.select("conv", "pos", F.xxhash64("pos", "x1").alias("k1"), F.xxhash64("pos", "x2").alias("k2"), "chars")
    found = running(_placed(keyed, "conv", "pos"), "conv", {"d1": (F.col("k1"), "xor"), "d2": (F.col("k2"), "xor")})
    return written(found.select("conv", (F.col("pos") + 1).alias("depth"), "d1", "d2", "chars"), "trie-prefixes")


def _chains(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, length, above (the depth of the node above its first own one), owns, parent (null: the root's owner)."""
    least = written(prefixes.groupBy(*_NODE).agg(F.min("conv").alias("owner")), "trie-minima")
    first, longest = convs.agg(F.min("conv"), F.max("length")).collect()[0]
    # Not owned at depth low, owned from depth high on; one more than the length: nowhere.
    searched = convs.select("conv", "length", F.when(F.col("conv") == first, -1).otherwise(0).cast("long").alias("low"), F.when(F.col("conv") == first, 0).otherwise(F.col("length") + 1).cast("long").alias("high"))
    for _ in range(int(longest or 0).bit_length()):
        asked = searched.where("high - low > 1").withColumn("depth", F.expr("(low + high) div 2"))
        owned = F.col("owner") == F.col("conv")
        told = asked.join(prefixes.select("conv", *_NODE), ["conv", "depth"]).join(least, _NODE).select("conv", "length", F.when(owned, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high"))
        searched = cut(searched.where("high - low <= 1").unionByName(told))
    chains = searched.select("conv", "length", F.col("low").alias("above"), (F.col("high") <= F.col("length")).alias("owns"))
    below_root = chains.where("above <= 0").select("*", F.when(F.col("above") == 0, F.lit(first)).cast("long").alias("parent"))
    deeper = chains.where("above > 0").withColumn("depth", F.col("above")).join(prefixes.select("conv", *_NODE), ["conv", "depth"]).join(least, _NODE)
    return written(below_root.unionByName(deeper.select("conv", "length", "above", "owns", F.col("owner").alias("parent"))), "trie-chains")


def _subtrees(chains: DataFrame, *values: str) -> DataFrame:
    """conv and the sums of values over each chain and all below it. In each round a chain gives its sums to the chain twice as far above as before."""
    state = cut(chains.select("conv", F.col("parent").alias("up"), *values))
    while state.where("up is not null").limit(1).count():
        rising = state.where("up is not null")
        given = rising.groupBy(F.col("up").alias("conv")).agg(*(F.sum(v).alias(f"{v} given") for v in values))
        higher = rising.select("conv", "up").join(state.select(F.col("conv").alias("up"), F.col("up").alias("next")), "up").select("conv", "next")
        summed = state.select("conv", *values).join(given, "conv", "left").join(higher, "conv", "left")
        state = cut(summed.select("conv", F.col("next").alias("up"), *((F.col(v) + F.coalesce(f"{v} given", F.lit(0))).alias(v) for v in values)))
    return state.select("conv", *values)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which follow one another, comma-joined."""
    node, digest = None, None
    for batch in batches:
        out = []
        for conv, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "ids")), strict=True):
            if (conv, depth) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        yield _digest_rows(out)
    yield _digest_rows([(*node, digest.hexdigest())] if node is not None else [])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv", "depth", "ends_sha256"])


def _ends(chains: DataFrame) -> DataFrame:
    """conv, depth, ends_sha256 of the nodes in which conversations end."""
    at = chains.select(F.when(F.col("owns"), F.col("conv")).otherwise(F.col("parent")).alias("at"), F.col("length").alias("depth"), "conv", F.expr(f"conv div {PIECE}").alias("piece"))
    pieces = at.groupBy("at", "depth", "piece").agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    texts = pieces.select(F.col("at").alias("conv"), "depth", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return texts.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "piece").mapInArrow(_digests, "conv long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of turns (conv, pos from 0, x1, x2, chars) of conversations (conv, length)."""
    prefixes = _prefixes(turns)
    chains = _chains(prefixes, convs)
    # Whether a chain's last node has children: chains that begin below it.
    last = chains.where("owns and parent is not null").select(F.col("parent").alias("conv"), F.col("above").alias("length")).distinct().withColumn("continued", F.lit(True))
    counted = chains.join(last, ["conv", "length"], "left").select("conv", "parent", F.lit(1).cast("long").alias("n"), (F.col("owns") & F.col("continued").isNull()).cast("long").alias("leaves"))
    sums = written(_subtrees(counted, "n", "leaves"), "trie-sums")
    attached = chains.where("parent is not null").join(sums, "conv").groupBy(F.col("parent").alias("conv"), F.col("above").alias("depth"))
    attached = attached.agg(F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), F.sum(F.col("owns").cast("long")).alias("children"))

    owned = prefixes.join(chains.where("owns").select("conv", "above", "length", "parent"), "conv").where("depth > above").select("conv", "depth", "chars", "above", "length", "parent")
    root = chains.where("parent is null").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "above", "length", "parent")
    nodes = owned.unionByName(root).join(attached, ["conv", "depth"], "left").fillna(0, ["n", "leaves", "children"])
    nodes = running(_placed(nodes, "conv", "depth"), "conv", {"below": (F.col("n"), "sum"), "leaves_below": (F.col("leaves"), "sum")}, from_end=True)
    own_leaf = counted.select("conv", F.col("leaves").alias("own_leaf"))
    nodes = written(nodes.join(own_leaf, "conv").select("*", (F.col("below") * F.col("chars")).alias("saved")), "trie-nodes")

    savings = nodes.groupBy("conv").agg(F.sum("saved").alias("saved"))
    saved = _subtrees(chains.select("conv", "parent").join(savings, "conv", "left").fillna(0, ["saved"]), "saved")
    given = chains.where("parent is not null").join(saved, "conv").groupBy(F.col("parent").alias("conv"), F.col("above").alias("depth")).agg(F.sum("saved").alias("given"))
    nodes = written(nodes.join(given, ["conv", "depth"], "left").fillna(0, ["given"]), "trie-saved")
    nodes = running(nodes, "conv", {"saved_tokens": (F.col("saved") + F.col("given"), "sum")}, from_end=True)
    nodes = nodes.join(_ends(chains), ["conv", "depth"], "left")
    begins = F.col("depth") == F.col("above") + 1
    return nodes.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(begins, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        (F.col("below") + 1).alias("n_convs"),
        (F.col("children") + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"),
        (F.col("leaves_below") + F.col("own_leaf")).alias("n_leaves"),
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text)."""
    return prefix_trie(*rebuilt(conversations))
