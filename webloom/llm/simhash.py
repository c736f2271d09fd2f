"""SimHash near copies: fingerprints of whole texts, linked through a hierarchical index in Gray order.

A text's fingerprint has a bit where more than half of its shingles (three words, repeats included, 64-bit hashes) have it.
Fingerprints link at ``most`` differing bits or fewer. Distinct fingerprints are sorted by Gray rank, in which neighbours share
most bits, and dealt into blocks of equal ranges of ranks. A node of the index is a run of fingerprints in this order with the
bits that all of them share, a masked pattern; upper nodes are runs of nodes, the uppermost ones whole blocks. Two nodes whose shared bits differ more
than ``most`` times have no link between what is below them and are dropped whole, on blocks before anything is shuffled.
Two blocks meet in one task, each with those fingerprints only that the other's pattern lets through. A search also drops nodes that
lie in one component already, so a dense group of near copies costs about its size, and a task gives at most one edge for each component that
it joins.

Null text, or none but blanks: fingerprint zero, linked like any other. Fewer than three words: the whole sequence is the one
shingle. Very long texts: whole, hashed piece by piece. Null doc_id: the row takes part; it names a component only if all
others are null too. Repeated rows are kept; equal fingerprints are one node. Ties: exactly half sets no bit; the least doc_id names
the component. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.cut import written
from webloom.llm.groups import components
from webloom.llm.words import by_size, utf8

#: Words of a shingle, differing bits of a link, the hash's seed.
WORDS, MOST, SEED = 3, 3, 42
#: Fingerprints of a block, as long as there are at most so many blocks: the patterns of all blocks are known to every task.
PER_BLOCK, MOST_BLOCKS = 1 << 14, 1024
#: Fingerprints below a lowest node, nodes below an upper one, pairs of nodes that are looked at together.
LEAF, FAN, AT_ONCE = 16, 8, 4096
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_U = np.uint64


# Fingerprints


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words, of about PIECE bytes at a time."""
    at = 0
    while at < len(data):
        end = _BLANK.search(data, at + PIECE)
        stop = end.end() if end else len(data)
        yield data[at:stop].lower().split()
        at = stop


def shingle_hashes(data: bytes, k: int = WORDS) -> Iterator[np.ndarray]:
    """The hashes of all shingles of a text, piece by piece."""
    held: list[bytes] = []
    none = True
    for words in _pieces(data):
        held += words
        if len(held) < k:
            continue
        none = False
        size = np.fromiter(map(len, held), np.int64, len(held))
        end = np.cumsum(size + 1) - 1
        joined, begin = b" ".join(held), (end - size)[: len(held) - k + 1]
        yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin.tolist(), end[k - 1 :].tolist(), strict=True)), _U, len(begin))
        held = held[len(held) - k + 1 :]
    if none and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], _U)


def fingerprint(data: bytes, k: int = WORDS) -> int:
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for hashes in shingle_hashes(data, k):
        n += len(hashes)
        for a in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row of docs (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            found = np.array([fingerprint(utf8(t)) for t in batch.column(1).to_pylist()], dtype=_U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long")


# The index


def gray_rank(fingerprint: Column) -> Column:
    """The place of a fingerprint in the order in which neighbours differ in one bit."""
    for n in (1, 2, 4, 8, 16, 32):
        fingerprint = fingerprint.bitwiseXOR(F.shiftrightunsigned(fingerprint, n))
    return fingerprint


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Index:
    """Fingerprints in Gray order, below levels of nodes: the bits that all below a node share, and which bits these are."""

    def __init__(self, fingerprints: np.ndarray, component: np.ndarray) -> None:
        self.fingerprints, self.component = fingerprints, component
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        both = either = fingerprints
        step = LEAF
        while not self.levels or len(both) > 1:
            at = np.arange(0, len(both), step)
            both, either, step = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(either, at), FAN
            self.levels.append((both, ~(both ^ either)))
        self.spans: tuple[int, list[tuple[np.ndarray, np.ndarray]]] = (-1, [])

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.levels[min(k, len(self.levels) - 1)]

    def span(self, k: int, top: np.ndarray, version: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest component below each node of a level."""
        if self.spans[0] != version:
            low = high = top[self.component]
            step, out = LEAF, []
            for _ in self.levels:
                at = np.arange(0, len(low), step)
                low, high, step = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), FAN
                out.append((low, high))
            self.spans = version, out
        return self.spans[1][min(k, len(self.levels) - 1)]


def joined(top: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """top, where each node names its component's least one, after the links x to y."""
    while True:
        a, b = top[x], top[y]
        apart = a != b
        if not apart.any():
            return top
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := top[top], top):
            top = up


def link(a: Index, b: Index, n: int, most: int = MOST) -> np.ndarray:
    """The least component that each of n components is linked with, by links between (or, if a is b, within) two indexes."""
    top, version = np.arange(n), 0
    zero = np.zeros(1, dtype=np.int64)
    heads = max(len(a.levels), len(b.levels)) - 1
    waiting = [(heads, zero, zero)]
    fan, leaf = np.arange(FAN), np.arange(LEAF)
    while waiting:
        k, x, y = waiting.pop()
        (low, high), (other_low, other_high) = a.span(k, top, version), b.span(k, top, version)
        apart = (low[x] != high[x]) | (other_low[y] != other_high[y]) | (low[x] != other_low[y])
        x, y = x[apart], y[apart]
        if not len(x):
            continue
        if k:
            x = np.broadcast_to((x[:, None, None] * FAN + fan[:, None]), (len(x), FAN, FAN)).ravel()
            y = np.broadcast_to((y[:, None, None] * FAN + fan[None, :]), (len(y), FAN, FAN)).ravel()
            (bits, mask), (other_bits, other_mask) = a.level(k - 1), b.level(k - 1)
            there = (x < len(bits)) & (y < len(other_bits))
            if a is b:
                there &= x <= y
            x, y = x[there], y[there]
            near = np.bitwise_count((bits[x] ^ other_bits[y]) & mask[x] & other_mask[y]) <= most
            x, y = x[near], y[near]
            order = np.argsort(-np.abs(x - y), kind="stable")  # what is taken last from the list is near in rank
            waiting += [(k - 1, x[order[i : i + AT_ONCE]], y[order[i : i + AT_ONCE]]) for i in range(0, len(x), AT_ONCE)]
            continue
        x, y = x[:, None, None] * LEAF + leaf[:, None], y[:, None, None] * LEAF + leaf[None, :]
        there = (x < len(a.fingerprints)) & (y < len(b.fingerprints))
        x, y = np.minimum(x, len(a.fingerprints) - 1), np.minimum(y, len(b.fingerprints) - 1)
        i, p, q = np.nonzero((differing(a.fingerprints[x], b.fingerprints[y]) <= most) & there)
        before = top
        top = joined(top.copy(), a.component[x[i, p, 0]], b.component[y[i, 0, q]])
        version += not np.array_equal(top, before)
    return top


def _packed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in arrays]


_BLOCK = "block int, bits long, mask long, fingerprints binary, labels binary"


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its fingerprints in order, and for each one of its component within the block."""
    from pyspark import TaskContext

    parts = [np.asarray(b.column(0)) for b in batches]
    if not sum(map(len, parts)):
        return
    f = np.concatenate(parts).view(_U)
    ids = np.arange(len(f))
    index = Index(f, ids)
    labels = f[link(index, index, len(f))]
    bits, mask = index.levels[-1]
    yield pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array(bits.view(np.int64)), pa.array(mask.view(np.int64)), *_packed(f, labels)], ["block", "bits", "mask", "fingerprints", "labels"]
    )


def _met(blocks: DataFrame) -> DataFrame:
    """Edges (a, b) between components of different blocks. The driver holds one pattern for each of MOST_BLOCKS blocks at most."""
    nodes = blocks.select("block", "bits", "mask").collect()
    ids, patterns, masks = (np.array([r[c] for r in nodes], dtype=np.int64) for c in ("block", "bits", "mask"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f, labels = np.frombuffer(row["fingerprints"], _U), np.frombuffer(row["labels"], _U)
                near = np.bitwise_count((np.int64(row["bits"]) ^ patterns) & np.int64(row["mask"]) & masks) <= MOST
                for block, bits, mask in zip(ids[near].tolist(), patterns[near].view(_U), masks[near].view(_U), strict=True):
                    passed = np.bitwise_count((f ^ bits) & mask) <= MOST
                    if block == row["block"] or not passed.any():
                        continue
                    low, high = sorted((block, row["block"]))
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (low, high, row["block"])] + _packed(f[passed], labels[passed]), ["low", "high", "block", "fingerprints", "labels"])

    def meet(rows: pa.Table) -> pa.Table:
        sides: dict[int, list[np.ndarray]] = {}
        for r in rows.to_pylist():
            sides[r["block"]] = [np.frombuffer(r[c], _U) for c in ("fingerprints", "labels")]
        a = b = np.zeros(0, dtype=_U)
        if len(sides) == 2:
            (f, f_labels), (g, g_labels) = sides.values()
            names, of = np.unique(np.concatenate([f_labels, g_labels]), return_inverse=True)
            top = link(Index(f, of[: len(f)]), Index(g, of[len(f) :]), len(names))
            moved = np.flatnonzero(top != np.arange(len(names)))
            a, b = names[moved], names[top[moved]]
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = blocks.select("block", "bits", "mask", "fingerprints", "labels").mapInArrow(route, "low int, high int, block int, fingerprints binary, labels binary")
    return routed.groupBy("low", "high").applyInArrow(meet, "a long, b long")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for f, labels in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (f, labels)], ["fingerprint", "local"])


def linked(prints: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """fingerprint and part, a label of its component, for each distinct fingerprint of prints (fingerprint)."""
    distinct = prints.select("fingerprint").distinct()
    n = distinct.count()
    rank = gray_rank(F.col("fingerprint"))
    ranges = distinct.repartitionByRange(max(1, min(MOST_BLOCKS, -(-n // per_block))), rank).sortWithinPartitions(rank)
    blocks = written(ranges.mapInArrow(_block, _BLOCK), "simhash-blocks")
    labels = components(_met(blocks))
    local = blocks.select("fingerprints", "labels").mapInArrow(_unpacked, "fingerprint long, local long")
    return local.join(labels, F.col("local") == F.col("node"), "left").select("fingerprint", F.coalesce("label", "local").alias("part"))


def near_copies(docs: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of docs (doc_id, text)."""
    prints = written(fingerprints(docs), "simhash-prints")
    parts = written(linked(prints, per_block).join(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "fingerprint"), "simhash-parts")
    # A written table: both sides of the join are dealt by the join itself, which splits a part of very many fingerprints.
    named = written(parts.groupBy("part").agg(F.min("first").alias("component_id")), "simhash-named")
    components_of = written(parts.join(named, "part").select("fingerprint", "component_id"), "simhash-components")
    rows = prints.join(components_of, "fingerprint")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
