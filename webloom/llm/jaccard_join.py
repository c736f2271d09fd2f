"""N-gram Jaccard join: size-aware, with enumerated subsets for light sets and inverted lists for heavy ones.

A document's set are its distinct shingles of ``words`` words, as 64-bit hashes; sets are linked from a similarity of
``percent`` on. Equal sets are one node. Sets of at most ``light``
shingles, a boundary chosen by cost, emit all their subsets of the size that a linked pair must share: a common subset is
a link. Larger sets are posted in inverted lists under their rarest shingles, as many as guarantee that linked sets
share one; the order is by a sketch of how often shingles occur in all documents. Lists first link their members to one of
them. What is then still apart is compared across components, each pair once, and only pairs that fit by size, position and a sketch of their sets
leave the join. So no link between components is missed and a group of near copies costs its size, not its square. Links between heavy sets are verified on whole sets; light ones are linked by a
common subset, known by its 64-bit hash.

Null text, or none but blanks: the empty set, linked with nothing, and a component of its own. Null doc_id: the row takes
part; it is the component's id only if all others are null too. Repeated rows are kept; equal texts are linked. Ties: the
least doc_id names the component. Very long texts: whole, like any other. No rows: no rows. Other columns are ignored. Hashes of different shingles or sets are
taken to differ (64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.cut import cut, small_side, written
from webloom.llm.groups import components, link_lists
from webloom.llm.sketch import cell_counts
from webloom.llm.words import by_size, mixed, shingles, utf8, word_hashes

#: The contract of the op3 query; other callers name their own.
WORDS, PERCENT = 4, 85
BITS = 20
#: Sets up to this size can be light; their elements are kept whole until the boundary is known.
MOST_LIGHT = 24
#: 64-bit words of a set's sketch.
SKETCH = 8
_U = np.uint64
_SET = _U(0xA0761D6478BD642F)


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    return np.unique(shingles(word_hashes(data), words))


def set_id(s: np.ndarray) -> int:
    return int(mixed(np.array([mixed(s ^ _SET).sum(dtype=np.uint64) + _U(len(s))], dtype=np.uint64)).view(np.int64)[0])


def sketch_of(s: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * SKETCH classes of elements, set if the set has an odd number of them: an element changes one."""
    odd = np.bincount((mixed(s ^ _SET) & _U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Elements that sets of n and m elements share at least if they are linked."""
    return -(-percent * (n + m) // (100 + percent))


def posted(n: int, percent: int = PERCENT) -> int:
    """Elements of a set of n, from the rarest on, of which a linked set has one at least."""
    return n - -(-percent * n // 100) + 1


def partners(n: int, percent: int = PERCENT) -> range:
    """Sizes of sets that can be linked with one of n elements."""
    return range(-(-percent * n // 100), n * 100 // percent + 1)


def summaries(docs: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, place (of the text), n, sid, head (the rarest elements, or all of a set that can be light) and sketch of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            sizes, ids, heads, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(utf8(text), words)
                sizes.append(len(s))
                ids.append(set_id(s))
                sketches.append(sketch_of(s))
                s = s[np.argsort(levels[(s >> _U(64 - BITS)).astype(np.int64)], kind="stable")]
                heads.append(s if len(s) <= MOST_LIGHT else s[: posted(len(s), percent)])
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            heads_column = pa.ListArray.from_arrays(ends, np.concatenate([*heads, np.zeros(0, dtype=np.uint64)]).view(np.int64))
            sketch_column = pa.ListArray.from_arrays(np.arange(0, len(sketches) * SKETCH + 1, SKETCH, dtype=np.int32), np.concatenate(sketches).view(np.int64))
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), heads_column, sketch_column]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "n", "sid", "head", "sketch"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, place long, n long, sid long, head array<long>, sketch array<long>"
    return docs.select("doc_id", "text", place_of("text").alias("place")).mapInArrow(work, schema)


def place_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def light_cost(n: int, light: int, percent: int = PERCENT) -> int:
    """Subsets that a light set of n elements emits."""
    return sum(comb(n, least_overlap(n, m, percent)) for m in partners(n, percent) if m <= light)


def boundary(histogram: dict[int, int], weight: int = 3, percent: int = PERCENT) -> int:
    """The largest light size, by the rows that both ways cost; a posted row costs weight times a subset, for its list's checks."""

    def cost(light: int) -> int:
        by_subsets = sum(c * light_cost(n, light, percent) for n, c in histogram.items() if n <= light)
        return by_subsets + sum(weight * c * posted(n, percent) for n, c in histogram.items() if n >= -(-percent * (light + 1) // 100))

    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def subset_links(nodes: DataFrame, light: int, percent: int) -> DataFrame:
    """Links (a, b) between light sets (sid, n, head)."""
    choices = {(n, c): np.array(list(combinations(range(n), c)), dtype=np.int64) for n in range(1, light + 1) for c in {least_overlap(n, m, percent) for m in partners(n, percent) if m <= light}}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, smaller = [], [], []
            for sid, n, head in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = mixed(np.sort(np.array(head, dtype=np.int64).view(np.uint64)) ^ _SET)
                for m in partners(n, percent):
                    if 1 <= m <= light:
                        k = mixed(s[choices[n, least_overlap(n, m, percent)]].sum(axis=1, dtype=np.uint64) + _U(min(n, m) * 1009 + max(n, m)))
                        keys.append(k)
                        ids += [sid] * len(k)
                        smaller += [n <= m] * len(k)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids, pa.int64()), pa.array(smaller)], ["key", "sid", "smaller"])

    rows = nodes.where(F.col("n").between(1, light)).select("sid", "n", "head").mapInArrow(work, "key long, sid long, smaller boolean")
    # The smaller sets of a key are linked with all others of it; two larger ones need not be.
    first = rows.groupBy("key").agg(F.min(F.when(F.col("smaller"), F.col("sid"))).alias("b"), F.count("*").alias("of")).where("of > 1 and b is not null").select("key", "b")
    return rows.join(first, "key").where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()


def _least(n: Column, percent: int) -> Column:
    """The size of the smallest set that can be linked with one of n elements."""
    return F.floor((percent * n + 99) / F.lit(100))


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """least_overlap of two columns."""
    return F.floor((percent * (n + m) + (99 + percent)) / F.lit(100 + percent))


def _can_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose posted elements have enough in common: beyond these a set has n - posted(n)."""
    rest = lambda n: F.floor((percent * n + 99) / F.lit(100)) - 1
    side = lambda a, n, h: nodes.select(F.col("sid").alias(a), F.col("n").alias(n), F.col("head").alias(h))
    both = pairs.join(side("a", "na", "ha"), "a").join(side("b", "nb", "hb"), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(shared >= _overlap(F.col("na"), F.col("nb"), percent) - F.greatest(rest(F.col("na")), rest(F.col("nb")))).select("a", "b")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are linked; only the texts of paired nodes are read again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 2):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    paired = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sets = written(elements(docs, small_side(cut(nodes.join(paired, "sid", "left_semi").select("doc_id", "place"))), words), "jaccard-sets")
    left, right = sets.select(F.col("sid").alias("a"), F.col("elements").alias("x")), sets.select(F.col("sid").alias("b"), F.col("elements").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def elements(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """sid and the whole set, sorted, of each of nodes (doc_id, place: a row of docs that has it)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 0):
            ids, sets = [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(utf8(text), words)
                ids.append(set_id(s))
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["sid", "elements"])

    wanted = nodes.select(F.col("doc_id").alias("of"), F.col("place").alias("at"))
    rows = docs.select("doc_id", "text", place_of("text").alias("place")).join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")))
    return rows.select("text").mapInArrow(work, "sid long, elements binary").dropDuplicates(["sid"])


def classes(docs: DataFrame, star_rounds: int = 1, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, text): its rows (doc_id, place, n, sid), the sets (sid, n, part, least doc_id, first row), and the parts."""
    counts = cell_counts(docs, lambda data: shingles(word_hashes(data), words), BITS)
    levels = np.ceil(np.log2(counts + 1)).astype(np.uint8)
    rows = written(summaries(docs, levels, words, percent), "jaccard-rows")
    nodes = written(
        rows.where("n > 0").groupBy("sid", "n").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.min("doc_id").alias("least"), F.first("head").alias("head"), F.first("sketch").alias("sketch")),
        "jaccard-nodes",
    ).select("sid", "n", "head", "sketch", "first.doc_id", "first.place", "least")
    histogram = {r[0]: r[1] for r in nodes.where(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").count().collect()}
    light = boundary(histogram, percent=percent)
    links = subset_links(nodes, light, percent)

    n_posted = F.col("n") - _least(F.col("n"), percent) + 1
    posts = nodes.where(100 * F.col("n") >= percent * (light + 1)).select("sid", "n", F.posexplode(F.slice("head", 1, n_posted.cast("int"))).alias("pos", "key"))
    posts = posts.withColumn("lookup", F.lit(False)).repartition("key")
    shared = posts.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("key")
    lists = written(posts.join(shared.hint("shuffle_hash"), "key"), "jaccard-lists")
    # Sets with few elements of their own lie in the middle of a group of near copies.
    own = F.max("n") - _least(F.max("n"), percent) + 1
    alone = lists.groupBy("sid").agg((own - F.count("*")).alias("alone"))
    lists = written(lists.join(alone, "sid"), "jaccard-lists")
    n, m = F.col("n"), F.col("other_n")
    overlap = _overlap(n, m, percent)
    # Of sets that share so many elements, one of these is among the first of both.
    fits = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.greatest(n, m) > light) & (F.col("pos") <= n - overlap) & (F.col("other_pos") <= m - overlap)

    # Sets that share so much differ in few elements, each of which changes a bit of the sketch.
    sketches = nodes.select("sid", "sketch")
    differing = F.aggregate(F.zip_with("sketch", "other_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)
    labels = link_lists(
        lists,
        components(links),
        lambda pairs: verified(docs, nodes, pairs, words, percent),
        fits,
        carry=("n", "pos", "alone"),
        central=("alone",),
        sift=lambda pairs: _can_link(pairs, nodes, percent),
        rounds=star_rounds,
        detail=(sketches, differing <= n + m - 2 * overlap),
    )
    joined = nodes.join(labels, F.col("sid") == F.col("node"), "left").select("sid", "n", "least", "doc_id", "place", F.coalesce("label", "sid").alias("part"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "place")).alias("first")
    parts = joined.groupBy("part").agg(F.min("least").alias("component"), first)
    return rows.select("doc_id", "place", "n", "sid"), joined, parts


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    rows, sets, parts = classes(docs, words=words, percent=percent)
    named = sets.join(parts, "part").select(F.col("sid").alias("of"), F.col("n").alias("of_n"), "component")
    return rows.join(named, (F.col("sid") == F.col("of")) & (F.col("n") == F.col("of_n")), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of docs, with all its columns, for each component: the first by doc_id, then by text. Empty sets all stay."""
    rows, _, parts = classes(docs.select("doc_id", "text"), words=words, percent=percent)
    kept = parts.select(F.col("first.doc_id").alias("of"), F.col("first.place").alias("at"))
    empty = rows.where("n = 0").select(F.col("doc_id").alias("of"), F.col("place").alias("at")).distinct()
    repeated = rows.where("n > 0").groupBy("doc_id", "place").count().where("count > 1")
    here = docs.select(*(F.col(f"`{c}`") for c in docs.columns), place_of("text").alias("jaccard place"))
    at = lambda keys: here["doc_id"].eqNullSafe(keys["of"]) & (here["jaccard place"] == keys["at"])
    kept_rows = here.join(kept, at(kept), "left_semi")
    if repeated.limit(1).count():
        kept_rows = kept_rows.dropDuplicates(["doc_id", "jaccard place"])
    empty_rows = here.join(empty, at(empty), "left_semi")
    return kept_rows.unionByName(empty_rows).drop("jaccard place")
