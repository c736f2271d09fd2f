"""Line dedup by a segment-partition edit join.

Lines are compared stripped and in lower case; blank ones are never dropped. Equal lines of any length are one. Two lines
are linked if they are within an edit for every PER_EDIT characters of the shorter one, EDITS at most; shorter lines have
no edits, since two edits make any word of three letters another. A line with so many edits is cut into one segment more,
one of which any line within reach holds at nearly the same place: each line is posted under its segments with its length,
and looks up, for each length that it can meet, the substrings that a segment of such a line can be. Where more than CROWD
lines are posted under a key that don't lie in one component, narrower keys decide which of them meet (``neighbours``), so a
line's work never grows with the number of lines that are like it. Candidates are verified by a banded bit-parallel edit
distance. Of each component of linked lines, the first one by doc_id, text and line number stays.

Null or empty text: no lines, unchanged. Very long texts and lines: whole, like any other. Null doc_id: after all others. Repeated rows (equal doc_id and text) are one
document: what is kept of one is kept of each. No rows: no rows. Other columns pass through ``deduped``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.cut import cut, small_side, written
from webloom.llm.edits import within
from webloom.llm.groups import CROWD, components, link_lists, paired, spanning, starred
from webloom.llm.neighbours import LETTER, keys_of
from webloom.llm.words import by_size, mixed

#: A line of MIN_CHARS characters or more can be dropped.
EDITS, PER_EDIT, MIN_CHARS = 2, 10, 1
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 5
_BACK = pow(_STEP, -1, 1 << 64)
_PAIR = _U(0xD6E8FEB86659FD93)
#: Parities that an edit can change: of two letter pairs before and two after it.
FLIPS = 4


def normalised(line: str) -> str:
    return line.strip().lower()


def place_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def allowed(n: int) -> int:
    """Edits between linked lines, the shorter of n characters."""
    return min(EDITS, n // PER_EDIT)


def segments(n: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of segment i of lines of n characters: as equal as can be, the longer ones last."""
    short, longer = n // (edits + 1), n % (edits + 1)
    first_long = edits + 1 - longer
    return short * i + np.maximum(0, i - first_long), short + (i >= first_long)


def lookups(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings that a line looks up, but for its own segments."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + edits - i)
            out += [(less, i, shift) for shift in range(low, high + 1) if less or shift]
    return out


#: By the edits. Keys of a line: its segments', then its lookups'.
LOOKUPS = {e: lookups(e) for e in range(1, EDITS + 1)}
KEYS = {e: e + 1 + len(found) for e, found in LOOKUPS.items()}


class _Hashes:
    """Hashes of substrings of joined lines, by sums of letters times powers."""

    def __init__(self, letters: np.ndarray) -> None:
        n = len(letters)
        power = np.full(n + 1, _STEP, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(letters.astype(np.uint64) + _U(1)) * power[:-1])])
        power[1:] = _BACK
        np.multiply.accumulate(power, out=power)
        self.back = power

    def of(self, begin: np.ndarray, length: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mixed((self.sums[begin + length] - self.sums[begin]) * self.back[begin] + mixed(salt.astype(np.uint64)))


class _Lines:
    """The hash of each normalised line and its parities.

    Parities: a bit for each of 64 classes of two letters in a row, set if the line has an odd number of them. An edit changes
    FLIPS at most.
    """

    def __init__(self, lines: list[str]) -> None:
        self.n = np.array([len(s) for s in lines], dtype=np.int64)
        letters = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.hashes = _Hashes(letters)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])[: len(lines)].astype(np.int64)
        bits = np.zeros(len(letters), dtype=np.uint64)
        if len(letters):
            two = letters[:-1].astype(np.uint64) * _PAIR + letters[1:]
            bits[:-1] = _U(1) << ((two * _PAIR) >> _U(58))
            bits[np.concatenate([self.begin[1:], [len(letters)]]) - 1] = 0  # the last letter of a line and the next line's first
        self.parities = np.bitwise_xor.reduceat(bits, self.begin) if lines else np.zeros(0, dtype=np.uint64)
        self.ids = self.hashes.of(self.begin, self.n, self.n)

    def keys(self, rows: np.ndarray, edits: int) -> np.ndarray:
        """KEYS[edits] keys of each of these lines. Equal keys are of one number of edits."""
        n, begin = self.n[rows], self.begin[rows]
        salt = lambda n, i: (n * 8 + edits) * 8 + i + 1
        keys = np.zeros((len(rows), KEYS[edits]), dtype=np.uint64)
        for i in range(edits + 1):
            at, size = segments(n, i, edits)
            keys[:, i] = self.hashes.of(begin + at, size, salt(n, i))
        for j, (less, i, shift) in enumerate(LOOKUPS[edits], edits + 1):
            m = np.maximum(n - less, 0)
            at, size = segments(m, i, edits)
            at = np.clip(at + shift, 0, n - size)
            keys[:, j] = self.hashes.of(begin + at, size, salt(m, i))
        return keys

    def posted(self, edits: int) -> np.ndarray:
        """Whether each line can be linked by so many edits: it has them, or is longer by what they can add."""
        high = (edits + 1) * PER_EDIT + edits if edits < EDITS else np.inf
        return (self.n >= edits * PER_EDIT) & (self.n < high)


class _Seen:
    """Numbers that a task has met, in sorted runs, each at least twice as long as the next."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def add(self, new: np.ndarray) -> np.ndarray:
        """Which of some sorted, distinct numbers are new; they are met now."""
        fresh = np.ones(len(new), dtype=bool)
        for run in self.runs:
            fresh &= run[np.minimum(np.searchsorted(run, new), len(run) - 1)] != new
        if fresh.any():
            self.runs.append(new[fresh])
            while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
                self.runs[-2:] = [np.sort(np.concatenate(self.runs[-2:]), kind="stable")]
        return fresh


def line_keys(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each normalised line, its parities, and its keys."""
    own = _Lines(lines)
    return own.ids, own.parities, own.keys(np.arange(len(lines)), edits)


def lines_of(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, place, the numbers and hashes of its lines, and by edits, keys of those new in the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in by_size(batches, 1, 1 << 18):
            numbers, lines, ends = [], [], [0]
            for text in batch.column(1).to_pylist():
                for i, line in enumerate((text or "").split("\n")):
                    if len(line := normalised(line)) >= MIN_CHARS:
                        numbers.append(i)
                        lines.append(line)
                ends.append(len(lines))
            own, ends = _Lines(lines), np.array(ends)
            ids = own.ids
            new, at = np.unique(ids, return_index=True)
            fresh = seen.add(new)
            is_new = np.zeros(len(ids), dtype=bool)
            is_new[at[fresh]] = True
            columns = [
                batch.column(0),
                batch.column(2),
                pa.ListArray.from_arrays(ends.astype(np.int32), np.array(numbers, dtype=np.int32)),
                pa.ListArray.from_arrays(ends.astype(np.int32), ids.view(np.int64)),
            ]
            for edits in KEYS:
                posted = is_new & own.posted(edits)
                new_ends = np.concatenate([[0], np.cumsum(posted)])[ends].astype(np.int32)
                columns += [
                    pa.ListArray.from_arrays(new_ends, ids[posted].view(np.int64)),
                    pa.ListArray.from_arrays(new_ends, own.parities[posted].view(np.int64)),
                    pa.ListArray.from_arrays(new_ends * KEYS[edits], own.keys(np.flatnonzero(posted), edits).ravel().view(np.int64)),
                ]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "place", "numbers", "ids", *(f"{c}{e}" for e in KEYS for c in ("fresh", "parities", "keys"))]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, place long, numbers array<int>, " + ", ".join(f"{n} array<long>" for n in names[3:])
    return docs.select("doc_id", "text", place_of("text").alias("place")).mapInArrow(work, schema)


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and normalised line of each of wanted (doc_id, place, number, sid)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 0):
            ids, lines = [], []
            for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split = text.split("\n")
                for r in rows:
                    ids.append(r["sid"])
                    lines.append(normalised(split[r["number"]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["sid", "line"])

    by_doc = small_side(cut(wanted.groupBy(F.col("doc_id").alias("of"), F.col("place").alias("at")).agg(F.collect_list(F.struct("number", "sid")).alias("rows"))), cells=F.size("rows"))
    rows = docs.select("doc_id", "text", place_of("text").alias("place")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")))
    return rows.select("text", "rows").mapInArrow(work, "sid long, line string").dropDuplicates(["sid"])


def verified(docs: DataFrame, sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines that are linked; only paired lines are read again, where sites has them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 2):
            keep = [within(x, y, allowed(min(len(x), len(y)))) is not None for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    paired = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    texts = written(line_texts(docs, sites.join(paired, "sid", "left_semi")), "line-texts")
    left, right = texts.select(F.col("sid").alias("a"), F.col("line").alias("x")), texts.select(F.col("sid").alias("b"), F.col("line").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _posts(rows: DataFrame, edits: int) -> DataFrame:
    """key, sid, lookup of the keys for so many edits."""
    keyed = rows.select(F.col(f"fresh{edits}").alias("fresh"), F.posexplode(f"keys{edits}").alias("j", "key"))
    return keyed.select("key", F.get("fresh", F.expr(f"cast(j div {KEYS[edits]} as int)")).alias("sid"), (F.col("j") % KEYS[edits] > edits).alias("lookup"))


def fits() -> Column:
    """Whether no more parities of two rows of a list differ than the edits can change."""
    return F.bit_count(F.col("parity").bitwiseXOR(F.col("other_parity"))) <= FLIPS * EDITS


def close(lines: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) that hold all links between lines (sid, part, parity, line) of different parts, for lines that too many are like.

    Level by level: keys that up to crowd lines are posted under are compared in pairs, the others' rows go to narrower keys.
    Each level leaves about a third of a line to be expanded, the last one none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 5, 1 << 20):
            at, keys, lookups, rests = [], [], [], []
            for i, (context, edits, rest) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                k, u, r = keys_of(np.frombuffer(rest, dtype=LETTER), context, edits)
                at += [i] * len(k)
                keys += k
                lookups += u
                rests += r
            take = batch.take(pa.array(at, pa.int64()))
            columns = [pa.array(keys, pa.int64()), *take.columns[:3], take.column(4), pa.array(lookups, pa.bool_()), pa.array(rests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "sid", "part", "parity", "edits", "lookup", "rest"])

    letters = F.encode("line", "utf-32")
    n = F.length("line")
    small = lines.where((n >= PER_EDIT) & (n < 2 * PER_EDIT + 1)).withColumn("edits", F.lit(1))
    rows = small.unionByName(lines.where(n >= 2 * PER_EDIT).withColumn("edits", F.lit(2)))
    rows = rows.select("sid", "part", "parity", F.col("edits").cast("long").alias("context"), "edits", letters.alias("rest"))
    found = None
    while True:
        keyed = written(rows.mapInArrow(work, "key long, sid long, part long, parity long, edits int, lookup boolean, rest binary"), "line-neighbours")
        shared = written(spanning(keyed), "line-neighbours")
        wide = shared.where("rest is not null")
        pairs = starred(shared.where("rest is null")).unionByName(paired(wide.where(F.col("posted") <= crowd), fits(), ("parity",)))
        found = pairs if found is None else found.unionByName(pairs)
        rows = wide.where(F.col("posted") > crowd).select("sid", "part", "parity", F.col("key").alias("context"), "edits", "rest")
        if not rows.limit(1).count():
            return found.distinct()


def dropped_lines(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, place, dropped (line numbers, from 0) of the documents that lose lines."""
    rows = written(lines_of(docs), "lines")
    keyed = reduce(DataFrame.unionByName, (_posts(rows, e) for e in KEYS))
    posts = keyed.repartition("key")
    # Keys that only lookups share link nothing.
    shared = posts.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.min("lookup").alias("l")).where("low < high and not l").select("key")
    lists = written(posts.join(shared.hint("shuffle_hash"), "key").distinct(), "line-lists")
    zipped = lambda e: F.arrays_zip(F.col(f"fresh{e}").alias("sid"), F.col(f"parities{e}").alias("parity"))
    parities = rows.select(F.explode(F.concat(*map(zipped, KEYS))).alias("l")).select("l.*")
    lists = written(lists.join(parities.join(lists.select("sid").distinct(), "sid", "left_semi").distinct(), "sid"), "line-lists")
    located = rows.select("doc_id", "place", F.explode(F.arrays_zip(F.col("numbers").alias("number"), F.col("ids").alias("sid"))).alias("l")).select("doc_id", "place", "l.number", "l.sid")
    here = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "place", "number")
    # Where a line is found first, to read its text there again, and how often it is found.
    sites = written(located.groupBy("sid").agg(F.min(here).alias("w"), F.count("*").alias("n")), "line-sites")
    at = sites.select("sid", "w.doc_id", "w.place", "w.number")

    def crowded(rows: DataFrame) -> DataFrame:
        wanted = cut(rows.select("sid", "part", "parity").distinct())
        return close(line_texts(docs, at.join(wanted, "sid", "left_semi")).join(wanted, "sid"), crowd)

    none = components(lists.sparkSession.createDataFrame([], "a long, b long"))
    labels = link_lists(lists, none, lambda pairs: verified(docs, at, pairs), fits(), crowded, carry=("parity",), first=("lookup",), crowd=crowd)
    # By distinct lines first: the parts of more than one line, and where each of them begins.
    known = sites.join(labels, F.col("sid") == F.col("node"), "left").select("sid", "w", "n", F.coalesce("label", "sid").alias("part"))
    firsts = written(known.groupBy("part").agg(F.min("w").alias("first"), F.sum("n").alias("n")).where("n > 1").select("part", "first"), "line-firsts")
    repeated = written(known.join(firsts, "part").select("sid", "n", "first"), "line-firsts")
    # A line that has more than a thousandth of all rows would fill a task: there are a thousand of these at most, broadcast.
    often = sites.agg(F.sum("n")).collect()[0][0] or 0
    common = F.col("n") * 1000 > often
    hot, others = (repeated.where(c).select(F.col("sid").alias("of"), "first") for c in (common, ~common))
    marked = located.join(F.broadcast(hot.withColumnRenamed("first", "hot_first")), F.col("sid") == F.col("of"), "left").drop("of")
    first = marked.where("hot_first is not null").select("doc_id", "place", "number", F.col("hot_first").alias("first"))
    rest = marked.where("hot_first is null").join(others, F.col("sid") == F.col("of")).select("doc_id", "place", "number", "first")
    gone = first.unionByName(rest).where(~here.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "place").agg(F.sort_array(F.collect_set("number")).alias("dropped"))


def _remaining(text: pa.Array, dropped: pa.Array) -> pa.Array:
    def kept(t: str | None, gone: set[int]) -> str | None:
        return t if t is None or not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)

    return pa.array([kept(t, set(d or ())) for t, d in zip(text.to_pylist(), dropped.to_pylist(), strict=True)], pa.string())


#: The column that deduped adds.
DROPPED = "line dedup dropped"


def deduped(docs: DataFrame) -> DataFrame:
    """All columns of docs, text without the dropped lines, and DROPPED, their numbers (null: none)."""
    # Most documents lose some line, so this side grows with the documents: never broadcast.
    gone = dropped_lines(docs.select("doc_id", "text")).select(F.col("doc_id").alias("line dedup of"), F.col("place").alias("line dedup at"), F.col("dropped").alias(DROPPED)).hint("merge")
    placed = docs.withColumn("line dedup place", place_of("text"))
    joined = placed.join(gone, placed["doc_id"].eqNullSafe(gone["line dedup of"]) & (placed["line dedup place"] == gone["line dedup at"]), "left")
    remaining = F.arrow_udf(_remaining, "string")
    changed = F.when(F.col(f"`{DROPPED}`").isNull(), placed["text"]).otherwise(remaining(placed["text"], F.col(f"`{DROPPED}`")))
    return joined.select(*(changed.alias("text") if c == "text" else placed[f"`{c}`"] for c in docs.columns), F.col(f"`{DROPPED}`"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars, kept_sha256 for every row of docs (doc_id, text)."""
    rows = deduped(docs.select("doc_id", "text"))
    text, dropped = F.coalesce("text", F.lit("")), F.col(f"`{DROPPED}`")
    n = F.when(dropped.isNull(), 0).otherwise(F.size(dropped)).cast("long")
    left = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select("doc_id", (left + n).alias("n_lines"), n.alias("n_dropped"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
