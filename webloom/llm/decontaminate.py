"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised: lower case, runs of blanks as one. A test item of n characters may have floor(rate * n) edits; cut
into one piece more than that, at least one piece is left whole in any match. An automaton finds all pieces in one pass
over a text; where a piece lies, the item's whole surroundings are verified by Myers' bit-parallel distance.

Null or empty texts match nothing, nor do null or blank items. Items so short that they may have no edit (12 characters at a rate of 8 %)
match where they begin and end with whole words. Null doc_id and repeated rows are kept, each with its own matches; equal items match alike. Ties: of several
places in a text the least distance counts, then the first. Very long texts and items: whole, like any other. Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webloom.cut import written
from webloom.llm.edits import Pattern
from webloom.llm.words import by_size

_BLANKS = re.compile(r"\s+")
#: Items in one automaton, by their bytes; more items are further passes over the documents.
BLOCK_BYTES = 8 << 20
RATE = 0.08


def normalised(text: str | None) -> str:
    return _BLANKS.sub(" ", (text or "").lower()).strip()


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of the edits + 1 pieces of an item, as equal as can be."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _whole_words(text: str, begin: int, end: int) -> bool:
    """Whether text[begin:end] cuts no word in two."""
    joined = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not joined(begin) and not joined(end)


class Matcher:
    """The automaton of a block of items (id, normalised text); those without an edit match as whole words."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(key, text, int(rate * len(text)), Pattern(text)) for key, text in items]
        places = defaultdict(list)
        for i, (_, text, edits, _) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                places[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end) of the items within their edits of some part of a normalised text."""
        if self.empty:
            return []
        starts, whole = defaultdict(set), {}
        for end, (length, found) in self.automaton.iter(text):
            for i, offset in found:
                if not self.items[i][2]:
                    if i not in whole and _whole_words(text, end + 1 - length, end + 1):
                        whole[i] = end + 1
                else:
                    starts[i].add(end + 1 - length - offset)
        out = [(self.items[i][0], 0, end) for i, end in whole.items()]
        for i, at in starts.items():
            key, item, edits, pattern = self.items[i]
            best, window = None, None
            for s in [*sorted(at), None]:
                low, high = (max(0, s - edits), s + len(item) + edits) if s is not None else (0, 0)
                if window and s is not None and low <= window[1]:
                    window = window[0], high
                    continue
                if window and (m := pattern.best(text[window[0] : window[1]], edits)) and (best is None or m[0] < best[0]):
                    best = m[0], window[0] + m[1]
                window = low, high
            if best:
                out.append((key, *best))
        return out


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, normalised text) of benchmark (item_id, text) in blocks of bounded size, one at a time."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = benchmark.select("item_id", "text").where("text is not null").distinct()
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        yield sorted(((r[0], t) for r in own if (t := normalised(r[1]))), key=lambda x: (x[0] is None, x))


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, end_at: the items of benchmark (item_id, text) that each row of docs (doc_id, text) holds.

    end_at is where the match ends in the normalised text. Each block of items is a pass over docs. The driver holds one block:
    the first one's rows are those of a plan, the others' are written before the next block is read.
    """
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("distance", T.LongType()), T.StructField("end_at", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def block(items: list[tuple[int, str]]) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for batch in by_size(batches, 1):
                rows = [(d, *m) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for m in matcher.matches(normalised(text))]
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

        return docs.select("doc_id", "text").mapInArrow(work, schema)

    blocks = blocks_of(benchmark)
    found = block(next(blocks))
    for items in blocks:
        found = found.unionByName(written(block(items), "leaks"))
    return found


def _leaking(items: list[tuple[int, str]], rate: float) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(items, rate)
        for texts in batches:
            yield pa.array([bool(t.is_valid and matcher.matches(normalised(t.as_py()))) for t in texts], pa.bool_())

    return work


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item of benchmark.

    Only texts go to Python; no row is shuffled. With more than one block of items the rows are written after each.
    """
    blocks = blocks_of(benchmark)
    items, more = next(blocks), next(blocks, None)
    while True:
        test = F.arrow_udf(_leaking(items, rate), "boolean")
        docs = docs.where(~test(docs["text"]))
        if more is None:
            return docs
        docs = written(docs, "clean")
        items, more = more, next(blocks, None)
