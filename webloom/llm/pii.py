"""Personal data: base patterns, and identifiers of other forms found by bootstrapped contexts.

Base spans come from fixed patterns (email, ip, card, phone), leftmost and not overlapping per kind, each found in time
linear in the text. They are the seeds, and so are, as secrets, hexadecimal words of 32 digits or more. What else could be an
identifier is a word with digits, a run of words of digits without letters, or words glued by ``(at)`` and the like; kinds have no patterns for them, but a
candidate's numbers of digits and of letters must lie in the range that the kind's seeds have (half of the least allowed).
The up to three words before a span, the one or two after it, and a label attached to it (``tel:``) are its lexical patterns.

A pattern's confidence for a kind is the confidence of the instances that it stands by, summed over their occurrences, as a
share of all occurrences of its words in the corpus; a seed's is 1, any other instance's one less the product of
(1 - confidence) over its patterns. After a few rounds, candidates of high confidence are added; a secret's own form never
suffices. No pattern is trusted on fewer than ``support`` different instances.

Null text: the empty text. Very long texts: whole, like any other; patterns and labels of any length. Offsets are code points,
the end exclusive. Null doc_id and repeated rows are kept, each with its own result (a repeated instance counts once towards the
support). Ties: an instance as sure for two kinds is of the first; a run of words that is sure goes before its words. No rows: no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.cut import cut, small_side, written
from webloom.llm.words import by_size, shingles, utf8, word_hashes

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0d]++")
_GLUE = re.compile(r"\(at\)|\[at\]|\(dot\)|\[dot\]")
_HEX = re.compile(r"[0-9a-fA-F]{32,}+")
_LABEL = re.compile(r"[^\x20\x09-\x0d:=0-9]++[:=]")


def luhn(digits: str) -> bool:
    odd, even = [int(d) for d in digits[-1::-2]], [int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    spans = []
    floor, at = 0, text.find("@")
    while at >= 0:
        left = text[floor:at]
        start = at - (len(left) - len(left.rstrip(_LOCAL)))
        floor = at + 1  # the local part holds no @, so no run reaches back over one
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append((EMAIL, start, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m.group().count(".") >= 3:
                start, parts = m.start(), m.group().split(".")
                for i in range(0, len(parts) - 3, 4):
                    end = start + sum(map(len, parts[i : i + 4])) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
                        spans.append((IP, start, end))
                    start = end + 1
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 16:
                digits = re.sub("[ -]", "", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans.append((CARD, m.start(), m.end()))
        if "+" in text:
            spans += [(PHONE, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return spans


def _free(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Which of the spans overlap no base span."""
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], np.maximum.accumulate(np.array([e for _, e in taken], dtype=np.int64))
    return [(i := bisect_right(starts, e - 1)) == 0 or reach[i - 1] <= s for s, e in spans]


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """A word or run of words without a label at its front and without what surrounds it."""
    label = _LABEL.match(text, start, end)
    if label:
        start = label.end()
    while start < end and not (text[start].isalnum() or text[start] == "+"):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    if start < end and start and text[start - 1] == "(" and ")" in text[start:end] and "(" not in text[start:end]:
        start -= 1
    return start, end


def candidates(text: str, base: list[tuple[int, int, int]], starts: array, ends: array) -> list[tuple[int, int, int, bool]]:
    """(run, start, end, whole) of runs of words that could be identifiers, and of the words of longer runs; none overlaps a base span."""
    like, glued = set(), set()
    for m in _DIGIT.finditer(text):
        like.add(bisect_right(starts, m.start()) - 1)
    for m in _GLUE.finditer(text):
        w = bisect_right(starts, m.start()) - 1
        glued.update(range(max(0, w - (m.start() == starts[w])), min(len(starts), w + 1 + (m.end() == ends[w]))))
    words = sorted(like | glued)
    letterless = lambda s, e: not any(map(str.isalpha, text[s:e]))
    joins = {w: w in glued or letterless(*_core(text, starts[w], ends[w])) for w in words}
    if base:
        words = [w for w, free in zip(words, _free([(starts[w], ends[w]) for w in words], base), strict=True) if free]
    runs: list[list[int]] = []
    for w in words:
        together = runs and runs[-1][-1] == w - 1 and joins[w] and joins[w - 1] and (w in glued) == (w - 1 in glued)
        if together and starts[w] == ends[w - 1] + 1 and text[ends[w - 1]] == " " and text[ends[w - 1] - 1] not in ".,;:!?":
            runs[-1].append(w)
        else:
            runs.append([w])
    found = []
    for r, run in enumerate(runs):
        spans = [(starts[run[0]], ends[run[-1]], True)] + ([(starts[w], ends[w], False) for w in run] if len(run) > 1 else [])
        for s, e, whole in spans:
            s, e = _core(text, s, e)
            if s < e:
                found.append((r, s, e, whole))
    return found


_SALTS = dict(zip(("left", "right", "label"), (np.uint64(0x5851F42D4C957F2D), np.uint64(0xDA942042E4DD58B5), np.uint64(0x8CB92BA72F3D8DD7)), strict=True))
LEFT, RIGHT = 3, 2


def patterns_of(text: str, start: int, end: int, starts: array, ends: array, grams: list[np.ndarray]) -> list[tuple[int, int]]:
    """(pattern, hash of its words) of a span: words before, words after, an attached label. grams[k]: hashes of each k + 1 words of the text."""
    found = []
    first, last = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
    before = text[starts[first] : start]
    if any(map(str.isalnum, before)):
        label = _LABEL.match(before)
        if label:
            gram = label_hash(label.group())
            found.append((gram ^ _SALTS["label"], gram))
    else:
        for k in range(min(LEFT, first)):
            gram = grams[k][first - 1 - k]
            found.append((gram ^ _SALTS["left"], gram))
    if not any(map(str.isalnum, text[end : ends[last]])):
        for k in range(min(RIGHT, len(starts) - 1 - last)):
            gram = grams[k][last + 1]
            found.append((gram ^ _SALTS["right"], gram))
    signed = lambda x: int(np.uint64(x).view(np.int64))
    return [(signed(p), signed(g)) for p, g in found]


def label_hash(label: str) -> np.uint64:
    return word_hashes(utf8(label))[0] ^ _SALTS["label"]


def grams_of(hashes: np.ndarray) -> list[np.ndarray]:
    return [shingles(hashes, k, whole_if_short=False) for k in range(1, max(LEFT, RIGHT) + 1)]


def instance(value: str) -> int:
    plain = re.sub(r"[^0-9a-z@:]", "", value.lower())
    return int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_SCAN = "row long, doc_id {key}, base array<struct<kind:int,start:int,end:int>>, found array<struct<seed:int,run:int,start:int,end:int,whole:boolean,instance:long,digits:int,letters:int,patterns:array<struct<pattern:long,gram:long>>>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_PATTERN = pa.struct([("pattern", pa.int64()), ("gram", pa.int64())])
_FOUND = pa.struct(
    [("seed", pa.int32()), ("run", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("whole", pa.bool_()), ("instance", pa.int64())]
    + [("digits", pa.int32()), ("letters", pa.int32()), ("patterns", pa.list_(_PATTERN))]
)


def scanned(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans of a text; and all instances: seeds (with their kind) and candidates, with their patterns."""
    base = base_spans(text)
    if not base and not _DIGIT.search(text) and not _GLUE.search(text):
        return base, []
    starts, ends = array("q"), array("q")
    for m in _WORD.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    every = [(k, -1, s, e, True) for k, s, e in base]
    for run, s, e, whole in candidates(text, base, starts, ends):
        secret = _HEX.fullmatch(text, s, e) and not text[s:e].isdigit() and not text[s:e].isalpha()
        every.append((SECRET if secret else -1, run, s, e, whole))
    if not every:
        return base, []
    grams = grams_of(word_hashes(utf8(text)))
    found = []
    for seed, run, s, e, whole in every:
        value = text[s:e]
        digits = sum("0" <= c <= "9" for c in value)
        found.append(
            {"seed": seed, "run": run, "start": s, "end": e, "whole": whole, "instance": instance(value), "digits": digits, "letters": sum(map(str.isalpha, value))}
            | {"patterns": [{"pattern": p, "gram": g} for p, g in patterns_of(text, s, e, starts, ends, grams)]}
        )
    return base, found


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of every row of docs (doc_id, text), and all instances with their patterns; row numbers the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in by_size(batches, 1):
            rows, bases, founds = [], [], []
            for text in batch.column(1).to_pylist():
                base, found = scanned(text or "")
                rows.append(row)
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                founds.append(found)
                row += 1
            arrays = [pa.array(rows, pa.int64()), batch.column(0), pa.array(bases, pa.list_(_SPAN)), pa.array(founds, pa.list_(_FOUND))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "base", "found"])

    return docs.select("doc_id", "text").mapInArrow(work, _SCAN.format(key=docs.schema["doc_id"].dataType.simpleString()))


#: Cells of the words that could be patterns; others aren't counted.
CELL_BITS = 22


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def gram_counts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """gram, total: how often each of grams (gram) occurs in all texts. Workers get a bit for each cell that has some, however many there are."""
    wanted = grams.select(F.shiftrightunsigned("gram", 64 - CELL_BITS).alias("cell")).distinct().toArrow()["cell"].to_numpy()
    flags = np.zeros(1 << CELL_BITS, dtype=bool)
    flags[wanted] = True
    bits = np.packbits(flags).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).view(bool)
        held, n = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

        for batch in by_size(batches, 0):
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                own = grams_of(word_hashes(utf8(text)))
                if ":" in text or "=" in text:
                    labels = [label_hash(m.group()) for m in _LABEL.finditer(text) if m.start() == 0 or _blank(text[m.start() - 1])]
                    own.append(np.array(labels, dtype=np.uint64))
                for h in own:
                    held.append(h[cells[_cells(h)]])
                    n += len(held[-1])
                if n > 1 << 21:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    counted = docs.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("total"))
    return counted.join(grams.select("gram").distinct(), "gram", "left_semi")


def _blank(c: str) -> bool:
    return c == " " or "\x09" <= c <= "\x0d"


def bootstrap(found: DataFrame, totals: DataFrame, rounds: int, support: int) -> DataFrame:
    """instance, kind, trust of instances that stand by trusted patterns.

    found: (pattern, instance, seed, n, total), seed being the kind or -1; totals are those of a pattern's words.
    """
    edges = cut(found.join(totals, "gram").select("pattern", "instance", "seed", "n", "total"))
    seeds = edges.where("seed >= 0").select("instance", F.col("seed").alias("kind")).distinct().withColumn("trust", F.lit(1.0))
    trust = seeds
    for k in range(rounds):
        shares = (
            edges.join(small_side(trust), "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum(F.col("n") * F.col("trust")).alias("right"), F.max("total").alias("total"), F.count_distinct(F.when(F.col("trust") >= 0.5, F.col("instance"))).alias("trusted"))
            .where(F.col("trusted") >= support)
            .select("pattern", "kind", F.least(F.lit(0.999), F.col("right") / F.col("total")).alias("share"))
        )
        # Left over: the chance that no pattern is right about the instance.
        by_pattern = edges.select("pattern", "instance").distinct().join(small_side(cut(shares)), "pattern")
        said = cut(by_pattern.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("share"))))).alias("trust")))
        trust = said.join(seeds, ["instance", "kind"], "left_anti").unionByName(seeds) if k < rounds - 1 else said
    return trust


def find(docs: DataFrame, rounds: int = 3, support: int = 5, confident: float = 0.8) -> DataFrame:
    """doc_id, base and added spans (arrays of kind, start, end) for every row of docs (doc_id, text)."""
    rows = written(scan(docs), "pii-scan")
    found = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    edges = found.select("instance", "seed", F.explode("patterns").alias("p")).groupBy("p.pattern", "p.gram", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = written(edges, "pii-edges")
    # Only patterns of enough different instances can ever count.
    wide = edges.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= support)
    edges = cut(edges.join(wide.select("pattern"), "pattern", "left_semi"))
    trust = bootstrap(edges, gram_counts(docs, edges.select("gram")), rounds, support).where(F.col("trust") >= confident)
    # What the seeds of a kind look like; one row for each kind.
    ranges = found.where("seed >= 0").groupBy(F.col("seed").alias("kind")).agg(
        F.floor(F.min("digits") / 2).alias("digits_from"), F.max("digits").alias("digits_to"), F.floor(F.min("letters") / 2).alias("letters_from"), F.max("letters").alias("letters_to")
    )
    # A number that is sure for two kinds is of the surer one.
    sure = (
        found.where("run >= 0")
        .join(small_side(trust), "instance")
        .join(F.broadcast(ranges), "kind")
        .where("digits between digits_from and digits_to and letters between letters_from and letters_to")
        .groupBy("row", "run", "start", "end", "whole")
        .agg(F.max(F.struct("trust", (-F.col("kind")).alias("first")))["first"].alias("kind"))
    )
    by_run = sure.groupBy("row", "run").agg(F.max("whole").alias("any_whole"), F.collect_list(F.struct((-F.col("kind")).alias("kind"), "start", "end", "whole")).alias("spans"))
    kept = by_run.select("row", F.explode(F.filter("spans", lambda s: s["whole"] == F.col("any_whole"))).alias("s"))
    added = kept.groupBy("row").agg(F.collect_list(F.struct("s.kind", "s.start", "s.end")).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and texts of the spans of (doc_id, base, added)."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *(count(k) for k in range(SECRET)),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
