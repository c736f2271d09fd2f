"""Language-model scores from an n-gram trie of order 3 in Elias-Fano form.

Training texts are counted in full, in two passes: the words, then pairs and triples of words together. Tasks send sorted,
summed runs, packed, to shards by the first word; each shard writes its part of the trie into the shared folder, where
executors map it into memory when they first need it. The levels are the words' hashes (monotone, a word's position is its
number) with their counts; the pointers to each word's followers (monotone) and the followers' numbers, made monotone by
adding what the context before ended with; and the same for the followers of each listed pair. A follower is found by a
successor search relative to its context. Words and pairs carry 8-bit logarithms of the weight that they leave for lower
orders, followers those of their discounted probability. A word that begins more than HOT n-grams has several parts, dealt
by a hash of the second word.

P(word) = (count - d) / N + u for known words, u for any other one, d being the share of words seen once among all and u
the unseen mass d * V / N by V + 1 types, so that unknown words are one type more, as in the base score.
P(word | context) = (count - D) / contexts, if listed, + left(context) * P(word | shorter context), where left(context) is what
the listed followers leave. N-grams seen less than ``least`` times aren't listed (all are by default). A context that isn't
listed counts as the shorter one; a text's first token has none, its second one word.

Null text: the empty text, whose only token is the end. Very long texts: whole, like any other. Null doc_id: held out.
Repeated rows are each counted and scored. Ties: equal texts score alike. Without training texts N = V = 0, the base score is 0 and so
is the score. No rows: no rows. Other columns are ignored.

The driver holds a row per shard (SHARD_BYTES of text) and per hot word (HOT occurrences).
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.cut import shared_dir, written
from webloom.llm.elias_fano import EliasFano
from webloom.llm.words import by_size, gathered, mixed, utf8, word_hashes

END = np.uint64(0x9AE16A3B2F90404F)
TOKENS_AT_ONCE = 1 << 21
#: Text bytes for each shard of the trie; occurrences from which on a word's followers are dealt to several parts.
SHARD_BYTES, HOT = 12 << 20, 4 << 20
#: Parts that a worker keeps mapped; tasks that write parts.
MOST_OPEN = MOST_TASKS = 10_000
DISCOUNT = 0.75
_U = np.uint64


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers byte by byte, which compresses well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(blob: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(blob, dtype=np.uint8, count=n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def packed(*columns: np.ndarray) -> bytes:
    """Columns of non-negative numbers, each of any length, in as many bytes as its largest number needs."""
    out = []
    for c in columns:
        width = max(1, (int(c.max(initial=0)).bit_length() + 7) // 8)
        out.append(len(c).to_bytes(8, "little") + bytes([width]) + _planes(c, width))
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    out, at, view = [], 0, memoryview(blob)
    while at < len(blob):
        n, width = int.from_bytes(view[at : at + 8], "little"), view[at + 8]
        out.append(_unplanes(view[at + 9 :], n, width))
        at += 9 + n * width
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys.astype(np.uint64), prepend=_U(0))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, the sums of their counts, and the place of each key among them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]])
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    return keys[starts], np.add.reduceat(counts[order], starts, dtype=np.int64) if len(starts) else np.zeros(0, dtype=np.int64), place


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, each text's followed by END, and where each text's begin."""
    parts = [word_hashes(utf8(t)) for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(parts) else np.zeros(0, dtype=np.int64)
    out = np.full(int(sizes.sum()), END, dtype=np.uint64)
    if len(out):
        inside = np.ones(len(out), dtype=bool)
        inside[begin + sizes - 1] = False
        out[inside] = np.concatenate(parts)
    return out, begin


def bits_of(n: int) -> int:
    return max(1, (n - 1).bit_length())


def joined(high: np.ndarray, low: np.ndarray, low_bits: int, highest: int) -> np.ndarray:
    """Two numbers in one of 64 bits."""
    if bits_of(highest) + low_bits > 64:
        raise ValueError(f"{highest} contexts in one part and {low_bits} bits of a word's number don't fit 64 bits; use smaller shards")
    return (high.astype(np.uint64) << _U(low_bits)) | low.astype(np.uint64)


class Trie:
    """The parts in a folder, mapped into memory when first needed."""

    def __init__(self, folder: str) -> None:
        self.folder, self.open = folder, {}
        about = stored(f"{folder}/about")
        self.shards, self.first, self.about = about["shards"], about["first"], about
        self.hot_words, self.hot_part, self.hot_parts = about["hot_words"], about["hot_part"], about["hot_parts"]
        left = f"{folder}/left"
        self.hot_left = stored(left)["left"] if os.path.exists(left) else np.zeros(len(self.hot_words))

    def part(self, name: str) -> dict:
        found = self.open.get(name)
        if found is None:
            if len(self.open) >= MOST_OPEN:
                self.open.pop(next(iter(self.open)))
            found = self.open[name] = stored(f"{self.folder}/{name}")
        return found

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number (-1: unknown) and the count of each word, by sorted hashes."""
        number, count = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        # Only the shards that have any of the words, however many there are in all.
        shards, first = np.unique(shard_of(hashes, self.shards), return_index=True)
        for s, a, b in zip(shards.tolist(), first.tolist(), [*first[1:].tolist(), len(hashes)], strict=True):
            part = self.part(f"words-{s}")
            level = EliasFano.stored("word", part)
            if level.n:
                key = hashes[a:b] - _U(shard_base(s, self.shards))
                at = level.successor(key, np.zeros(b - a, dtype=np.int64), np.full(b - a, level.n, dtype=np.int64))
                safe = np.minimum(at, level.n - 1)
                found = (at < level.n) & (level.at(safe) == key)
                number[a:b] = np.where(found, at + self.first[s], -1)
                count[a:b] = np.where(found, part["counts"][safe].astype(np.int64), 0)
        return number, count

    def parts_of(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each pair of (word number >= 0, hash of the second word), and the context's number in it."""
        shard = np.searchsorted(self.first, context, side="right") - 1
        local = context - self.first[shard]
        if len(self.hot_words):
            h = np.minimum(np.searchsorted(self.hot_words, context), len(self.hot_words) - 1)
            hot = self.hot_words[h] == context
            dealt = (mixed(word) % self.hot_parts[h].astype(np.uint64)).astype(np.int64)
            shard, local = np.where(hot, self.hot_part[h] + dealt, shard), np.where(hot, 0, local)
        return shard, local

    def followers(self, level: int, part: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the followers ``word`` (-1: unknown) of contexts in parts: place in the part (-1: not listed), probability or 0, and what contexts leave."""
        place, prob, left = np.full(len(part), -1, dtype=np.int64), np.zeros(len(part)), np.zeros(len(part))
        order = np.argsort(part, kind="stable")
        at_part, cuts = np.unique(part[order], return_index=True)
        for p, own in zip(at_part.tolist(), np.split(order, cuts[1:]), strict=True):
            found = self.part(f"followers-{p}")
            here = context[own]
            left[own] = 10.0 ** opened(found[f"left{level}"][here], found[f"left{level}_range"])
            nexts = EliasFano.stored(f"next{level}", found)
            if not nexts.n:
                continue
            froms = EliasFano.stored(f"from{level}", found)
            begin, end = froms.at(here).astype(np.int64), froms.at(here + 1).astype(np.int64)
            some = np.flatnonzero((end > begin) & (word[own] >= 0))
            begin, end, own = begin[some], end[some], own[some]
            before = np.where(begin > 0, nexts.at(np.maximum(begin - 1, 0)), _U(0))
            wanted = before + word[own].astype(np.uint64)
            at = nexts.successor(wanted, begin, end)
            hit = at < end
            hit &= nexts.at(np.where(hit, at, 0)) == wanted
            place[own[hit]] = at[hit]
            prob[own[hit]] = 10.0 ** opened(found[f"prob{level}"][at[hit]], found[f"prob{level}_range"])
        if level == 2 and len(self.hot_words):
            hot = part >= self.shards
            left[hot] = self.hot_left[np.searchsorted(self.hot_part, part[hot], side="right") - 1]
        return place, prob, left


def quantised(logs: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Logarithms in 8 bits, and their range."""
    low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
    return np.round((logs - low) * (255 / (high - low) if high > low else 0)).astype(np.uint8), [low, high]


def opened(codes: np.ndarray, span: list[float]) -> np.ndarray:
    return span[0] + codes * ((span[1] - span[0]) / 255)


def shard_base(s: int, shards: int) -> int:
    return -(-(s << 64) // shards)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard whose base is the last one up to each hash: hash * shards / 2**64, for fewer than 2**32 shards."""
    high, low = hashes >> _U(32), hashes & _U(0xFFFFFFFF)
    return ((high * _U(shards) + (low * _U(shards) >> _U(32))) >> _U(32)).astype(np.int64)


def _save(path: str, arrays: dict[str, np.ndarray], about: dict) -> None:
    """One file of arrays and numbers, written under another name first: a lost or repeated task leaves a whole file or none."""
    names = {n: (a.dtype.str, len(a)) for n, a in arrays.items()}
    head = json.dumps({"arrays": names, "about": about}).encode()
    head += b" " * (-len(head) % 16)
    under_way = f"{path}.{uuid.uuid4().hex}"
    with open(under_way, "wb") as f:
        f.write(len(head).to_bytes(16, "little") + head)
        for a in arrays.values():
            data = np.ascontiguousarray(a).tobytes()
            f.write(data + bytes(-len(data) % 16))
    os.rename(under_way, path)


def stored(path: str) -> dict:
    """The arrays, mapped, and the numbers of a file."""
    raw = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
    at = 16 + int.from_bytes(raw[:16].tobytes(), "little")
    head = json.loads(raw[16:at].tobytes())
    found = dict(head["about"])
    for name, (kind, n) in head["arrays"].items():
        size = np.dtype(kind).itemsize * n
        found[name] = raw[at : at + size].view(kind)
        at += size + -size % 16
    return found


_OPEN: dict[tuple[str, bool], Trie] = {}


def _trie(folder: str, whole: bool) -> Trie:
    """This worker's mapping of the folder, of which the words or the whole trie is written."""
    if (folder, whole) not in _OPEN:
        _OPEN.clear()
        _OPEN[folder, whole] = Trie(folder)
    return _OPEN[folder, whole]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    held, n = [], 0
    for batch in by_size(batches, 0, 1 << 22):
        held += batch.column(0).to_pylist()
        n += batch.column(0).nbytes
        if n > 6 * TOKENS_AT_ONCE:
            yield held
            held, n = [], 0
    if held:
        yield held


def _runs(parts: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "run"])


def _cut_by(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of a sorted array and where each begins, and the end."""
    distinct, begin = np.unique(part, return_index=True)
    return distinct, np.append(begin, len(part))


def level_of(name: str, context: np.ndarray, contexts: int, word: np.ndarray, share: np.ndarray) -> tuple[dict, dict, np.ndarray]:
    """Arrays and numbers of a level: followers (context, word), sorted, with their discounted shares; and the shares' sums."""
    size = np.bincount(context, minlength=contexts)
    begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    # The last follower of each context is added to those of all later ones.
    has = np.flatnonzero(size)
    ends = np.cumsum(word[begin[has + 1] - 1].astype(np.uint64), dtype=np.uint64)
    base = np.repeat(np.concatenate([np.zeros(min(1, len(has)), dtype=np.uint64), ends[:-1]]), size[has])
    froms, nexts = EliasFano.of(begin, len(word) + 1), EliasFano.of(word.astype(np.uint64) + base, int(ends[-1]) + 1 if len(ends) else 1)
    listed = np.bincount(context, weights=share, minlength=contexts)
    probs, probs_range = quantised(np.log10(share))
    left, left_range = quantised(np.log10(np.clip(1 - listed, 1e-9, 1)))
    from_arrays, from_about = froms.parts(f"from{name}")
    next_arrays, next_about = nexts.parts(f"next{name}")
    about = from_about | next_about | {f"prob{name}_range": probs_range, f"left{name}_range": left_range}
    return from_arrays | next_arrays | {f"prob{name}": probs, f"left{name}": left}, about, listed


def train(texts: DataFrame, discount: float = DISCOUNT, least: int = 1, hot: int = HOT) -> str:
    """Writes the trie of texts (text); its folder."""
    spark = texts.sparkSession
    shared = urlparse(shared_dir(spark))
    if shared.scheme not in ("", "file"):
        raise ValueError(f"the trie is mapped from a mounted shared folder; spark.checkpoint.dir is {shared.geturl()}")
    folder = f"{unquote(shared.path)}/trie-{uuid.uuid4().hex}"
    os.makedirs(folder)
    size = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    shards = max(4, -(-size // SHARD_BYTES))
    bases = np.array([shard_base(s, shards) for s in range(1, shards)], dtype=np.uint64)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            words, counts, _ = summed(np.concatenate([w for w, _ in held]), np.concatenate([c for _, c in held]))
            part, cuts = _cut_by(np.searchsorted(bases, words, side="right"))
            return _runs(part, [packed(_steps(words[a:b]), counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

        for group in _texts(batches):
            held.append(np.unique(tokens_of(group)[0], return_counts=True))
            n += len(held[-1][0])
            if n > TOKENS_AT_ONCE:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    def write_words(rows: pa.Table) -> pa.Table:
        s = rows["part"][0].as_py()
        runs = [unpacked(r) for r in rows["run"].to_pylist() if r is not None]
        none = np.zeros(0, dtype=np.uint64)
        words, counts, _ = summed(np.concatenate([none, *(np.cumsum(k, dtype=np.uint64) for k, _ in runs)]), np.concatenate([none, *(c for _, c in runs)]))
        base = shard_base(s, shards)
        ef = EliasFano.of(words - _U(base), shard_base(s + 1, shards) - base)
        wide = np.uint32 if int(counts.max(initial=0)) < 1 << 32 else np.uint64
        arrays, about = ef.parts("word")
        _save(f"{folder}/words-{s}", arrays | {"counts": counts.astype(wide)}, about)
        often = np.flatnonzero(counts > hot)
        sums = [pa.array([int(v)], pa.int64()) for v in (len(words), counts.sum(), (counts == 1).sum())]
        return pa.table([pa.array([s], pa.int32()), *sums, *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (often, counts[often]))], ["part", "n", "total", "once", "often", "counts"])

    # As many tasks as parts: what a task reads doesn't grow with the texts.
    dealt = lambda runs, n: runs.repartition(min(n, MOST_TASKS), "part")
    every = lambda n: spark.range(n).select(F.col("id").cast("int").alias("part"), F.lit(None).cast("binary").alias("run"))
    runs = texts.select("text").mapInArrow(count_words, "part int, run binary").unionByName(every(shards))
    found = sorted(dealt(runs, shards).groupBy("part").applyInArrow(write_words, "part int, n long, total long, once long, often array<long>, counts array<long>").collect())
    first = np.concatenate([[0], np.cumsum([r["n"] for r in found])]).astype(np.int64)
    total, distinct = sum(r["total"] for r in found), int(first[-1])
    often = [(int(first[r["part"]]) + i, c) for r in found for i, c in zip(r["often"], r["counts"], strict=True)]
    hot_parts = np.array([-(-c // hot) for _, c in often], dtype=np.int64)
    hot_part = shards + np.concatenate([[0], np.cumsum(hot_parts)[:-1]]).astype(np.int64)[: len(often)]
    parts = shards + int(hot_parts.sum())
    about = {"shards": shards, "total": total, "words": distinct, "seen_once": min(0.95, max(0.05, sum(r["once"] for r in found) / distinct)) if distinct else 0.0}
    arrays = {"first": first, "hot_words": np.array([w for w, _ in often], dtype=np.int64), "hot_counts": np.array([c for _, c in often], dtype=np.int64)}
    _save(f"{folder}/about", arrays | {"hot_part": hot_part, "hot_parts": hot_parts}, about)
    word_bits = bits_of(distinct + 1)

    def count_followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(folder, False)
        for group in _texts(batches):
            tokens, begin = tokens_of(group)
            words, at = np.unique(tokens, return_inverse=True)
            number, _ = trie.words(words)
            inside = np.ones(len(tokens), dtype=bool)
            inside[begin] = False  # the token before a text's first is another's end
            second = np.flatnonzero(inside)
            if not len(second):
                continue
            n = np.int64(len(words))
            pairs, pair_at, pair_counts = np.unique(at[second - 1] * n + at[second], return_inverse=True, return_counts=True)
            pair_of = np.full(len(tokens), -1, dtype=np.int64)
            pair_of[second] = pair_at
            third = second[inside[second - 1]]
            triples, triple_counts = np.unique(pair_of[third - 1] * n + at[third], return_counts=True)
            u, v = pairs // n, pairs % n
            part, local = trie.parts_of(number[u], words[v])
            # By part, then context and word; each triple stays with its pair.
            order = np.argsort(part, kind="stable")
            fan = np.bincount(triples // n, minlength=len(pairs))
            triple_order = np.argsort(part[triples // n], kind="stable")
            cut_parts, cuts = _cut_by(part[order])
            fan, w, triple_counts = fan[order], number[triples % n][triple_order], triple_counts[triple_order]
            pair_key, pair_counts = joined(local[order], number[v[order]], word_bits, int(local.max()) + 1), pair_counts[order]
            ends = np.concatenate([[0], np.cumsum(fan)])
            blobs = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                c, d = ends[a], ends[b]
                blobs.append(packed(_steps(pair_key[a:b]), pair_counts[a:b], fan[a:b], w[c:d], triple_counts[c:d]))
            yield _runs(cut_parts, blobs)

    def write_followers(rows: pa.Table) -> pa.Table:
        p = rows["part"][0].as_py()
        keys, counts, fans, thirds, third_counts = ([np.zeros(0, dtype=np.uint64)] for _ in range(5))
        for r in rows["run"].to_pylist():
            if r is not None:
                for held, c in zip((keys, counts, fans, thirds, third_counts), unpacked(r), strict=True):
                    held.append(c)
        keys[1:] = [np.cumsum(k, dtype=np.uint64) for k in keys[1:]]
        pair, n, place = summed(np.concatenate(keys), np.concatenate(counts))
        of = np.repeat(place, np.concatenate(fans).astype(np.int64))
        triple, m, _ = summed(joined(of, np.concatenate(thirds), word_bits, max(1, len(pair))), np.concatenate(third_counts))
        del keys, counts, fans, thirds, third_counts, of, place
        mask = _U((1 << word_bits) - 1)
        of, third = (triple >> _U(word_bits)).astype(np.int64), triple & mask
        kept = n >= least
        listed = m >= least
        of, third, m = of[listed], third[listed], m[listed]
        of = (np.cumsum(kept) - 1)[of] if len(of) else of
        pair, n = pair[kept], n[kept]
        context, word = (pair >> _U(word_bits)).astype(np.int64), pair & mask
        if p < shards:
            own = stored(f"{folder}/words-{p}")["counts"].astype(np.float64)
        else:
            own = np.array([often[int(np.searchsorted(hot_part, p, side="right")) - 1][1]], dtype=np.float64)
        two, two_about, mass = level_of("2", context, len(own), word, (n - discount) / own[context])
        three, three_about, _ = level_of("3", of, len(pair), third, (m - discount) / n[of])
        _save(f"{folder}/followers-{p}", two | three, two_about | three_about)
        return pa.table([pa.array([p], pa.int32()), pa.array([float(mass[0]) if p >= shards else 0.0])], ["part", "mass"])

    runs = texts.select("text").mapInArrow(count_followers, "part int, run binary").unionByName(every(parts))
    masses = {r["part"]: r["mass"] for r in dealt(runs, parts).groupBy("part").applyInArrow(write_followers, "part int, mass double").where("mass > 0").collect()}
    left = [max(1e-9, 1 - sum(masses.get(int(a) + i, 0.0) for i in range(int(k)))) for a, k in zip(hot_part, hot_parts, strict=True)]
    _save(f"{folder}/left", {"left": np.array(left, dtype=np.float64)}, {})
    return folder


def held_out(doc_id: Column, folds: int = 10, fold: int = 0) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score_texts(trie: Trie, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, known tokens, base score and score of each text."""
    tokens, begin = tokens_of(texts)
    words, at = np.unique(tokens, return_inverse=True)
    number, counts = trie.words(words)
    total, distinct, d = trie.about["total"], trie.about["words"], trie.about["seen_once"]
    base = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
    unseen = d * distinct / total / (distinct + 1) if total else 1.0
    plain = np.where(number >= 0, (counts - d) / max(1, total), 0.0) + unseen
    probs = plain[at]
    inside = np.ones(len(tokens), dtype=bool)
    inside[begin] = False
    second = np.flatnonzero(inside)
    second = second[number[at[second - 1]] >= 0]
    if len(second):
        n = np.int64(len(words))
        pairs, back = np.unique(at[second - 1] * n + at[second], return_inverse=True)
        u, v = pairs // n, pairs % n
        part, local = trie.parts_of(number[u], words[v])
        place, listed, left = trie.followers(2, part, local, number[v])
        probs[second] = (listed + left * plain[v])[back]
        pair_of = np.full(len(tokens), -1, dtype=np.int64)
        pair_of[second] = back
        # Triples whose first two words are a listed pair; most occur once in a text, so each place is looked up.
        third = second[inside[second - 1]]
        context = pair_of[third - 1]
        known = np.flatnonzero((context >= 0) & (place[np.maximum(context, 0)] >= 0))
        known = known[np.argsort(context[known])]  # places near each other in the trie are read together
        third, context = third[known], context[known]
        if len(third):
            _, listed, left = trie.followers(3, part[context], place[context], number[at[third]])
            probs[third] = listed + left * probs[third]
    logs = np.log10(probs)
    sizes = np.diff(np.concatenate([begin, [len(tokens)]]))
    return sizes, np.add.reduceat((number >= 0)[at].astype(np.int64), begin), np.add.reduceat(base[at], begin), np.add.reduceat(logs, begin)


def scores(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    The model learns from the rows that are not held out. The rows are written, and the trie is deleted then.
    """
    folder = train(docs.where(~held_out(F.col("doc_id"))).select("text"), **options)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(folder, True)
        for batch in by_size(gathered(batches, 2, 4 * TOKENS_AT_ONCE), 2, 6 * TOKENS_AT_ONCE):
            n, known, base, score = score_texts(trie, batch.column(2).to_pylist())
            total = np.full(len(n), trie.about["total"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (n, known, total, base, score))], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = written(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(work, schema), "lm-scores")
    shutil.rmtree(folder, ignore_errors=True)
    return rows
