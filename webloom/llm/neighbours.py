"""Narrow keys for strings of which too many share a wider one, so that only neighbours meet.

Two strings within so many edits, the shorter one cut into PARTS segments, are equal but for two of these, wherever their
edits lie. So a string is posted under itself without each two segments, and looks up what a string of each length that it can
meet would be without two of its own. What is left out is the row's rest, which decides within a key: it is expanded in the
same way, until it has DIRECT letters at most (two more are expanded in both ways). Then each string is posted with letters left open or deleted, such that an equal
key means that two rests are within the edits: all members of a key are linked, and one of them stands for all. The number of
a string's keys never depends on how many strings are like it.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

from webloom.llm.words import mixed

PARTS, DIRECT, MOST_EDITS = 6, 24, 2
#: Code points as the JVM encodes them in UTF-32, and what stands between the parts of a rest: no letter, and never edited.
LETTER = np.dtype(">u4")
SEPARATOR = 0xFFFFFFFF
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 5
_BACK = pow(_STEP, -1, 1 << 64)
_OPEN = mixed(np.array([0xF00DFACE], dtype=np.uint64))[0]
_KIND = mixed(np.arange(301, 309, dtype=np.uint64))
PLAIN, OPEN_TWO, LESS_ONE, OPEN_ONE, CUT = range(5)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_STEP, DIRECT + MOST_EDITS)


def letters_of(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-be", "surrogatepass"), dtype=LETTER)


def _cuts() -> np.ndarray:
    """Rows (less, i, j, shift): a string of n letters against one of n - less, of whose segments i and j differ, shift letters more in i."""
    rows = [(0, i, j, s) for i, j in combinations(range(PARTS), 2) for s in (0, 1, -1)]
    rows += [(less, i, j, s) for less in (1, 2) for i, j in combinations(range(PARTS), 2) for s in range(less + 1)]
    return np.array(rows, dtype=np.int64)


_CUTS = _cuts()


def cut_keys(rest: np.ndarray, context: int) -> list[tuple[int, bool, bytes]]:
    """(key, lookup, rest) of a string of more than DIRECT letters: each two segments of it, or of a string that it can meet."""
    less, i, j, shift = _CUTS.T
    n = len(rest)
    m = n - less
    short, longer = m // PARTS, m % PARTS
    begin = lambda k: short * k + np.maximum(0, k - (PARTS - longer))
    a, a_end, b, b_end = begin(i), begin(i + 1) + shift, begin(j) + shift, begin(j + 1) + less
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(rest.astype(np.uint64) + _U(1)) * _powers(_STEP, n)[:-1])])
    back = _powers(_BACK, n)
    part = lambda x, y: mixed((sums[y] - sums[x]) * back[x])
    salt = mixed(((m * PARTS + i) * PARTS + j).astype(np.uint64) + _KIND[CUT])
    keys = mixed(part(np.zeros_like(a), a) + part(a_end, b) * _U(3) + part(b_end, np.full_like(b, n)) * _U(5) + salt + _U(context & (1 << 64) - 1))
    separator = np.array([SEPARATOR], dtype=LETTER).tobytes()
    lookup = (less > 0) | (shift != 0)
    return [(int(k), bool(u), rest[p:q].tobytes() + separator + rest[r:s].tobytes()) for k, u, p, q, r, s in zip(keys.view(np.int64), lookup, a, a_end, b, b_end, strict=True)]


@cache
def _without(n: int) -> np.ndarray:
    """Row i: the places 0 to n - 1 but for i."""
    return np.array([[p for p in range(n) if p != i] for i in range(n)], dtype=np.int64).reshape(n, max(0, n - 1))


def direct_keys(rest: np.ndarray, context: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a string of up to DIRECT + MOST_EDITS letters, and whether each is a lookup. An equal key, not of two lookups: within the edits."""
    n = len(rest)
    values = mixed(rest.astype(np.uint64) + _U(1))
    free = np.flatnonzero(rest != SEPARATOR)

    def hashed(rows: np.ndarray, kind: int) -> np.ndarray:
        size = rows.shape[1]
        return mixed((rows * _POWER[:size]).sum(axis=1, dtype=np.uint64) + _KIND[kind] + _U(size) + mixed(np.array([context & (1 << 64) - 1, edits], dtype=np.uint64)).sum(dtype=np.uint64))

    def opened(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        rows = rows.copy()
        rows[np.arange(len(rows))[:, None], places] = _OPEN
        return rows

    one = values[_without(n)[free]] if n else np.zeros((0, 0), dtype=np.uint64)
    posted = [hashed(values[None, :], PLAIN), hashed(opened(np.repeat(values[None, :], len(free), axis=0), free[:, None]), OPEN_ONE)]
    lookups = [hashed(one, PLAIN)]
    if edits > 1:
        two = np.array(list(combinations(free, 2)), dtype=np.int64).reshape(-1, 2)
        posted += [hashed(opened(np.repeat(values[None, :], len(two), axis=0), two), OPEN_TWO), hashed(one, LESS_ONE)]
        if len(two):
            lookups.append(hashed(values[np.array([np.delete(np.arange(n), t) for t in two])], PLAIN))
            # One letter deleted, another one left open.
            gone = np.concatenate([two, two[:, ::-1]])
            place = gone[:, 1] - (gone[:, 1] > gone[:, 0])
            lookups.append(hashed(opened(values[_without(n)[gone[:, 0]]], place[:, None]), OPEN_ONE))
    posted_keys, lookup_keys = np.unique(np.concatenate(posted)), np.unique(np.concatenate(lookups))
    lookup_keys = np.setdiff1d(lookup_keys, posted_keys, assume_unique=True)
    return np.concatenate([posted_keys, lookup_keys]).view(np.int64), np.repeat([False, True], [len(posted_keys), len(lookup_keys)])


def keys_of(rest: np.ndarray, context: int, edits: int) -> tuple[list[int], list[bool], list[bytes | None]]:
    """All keys of a string within a wider key: whether each is a lookup, and the rest that decides within it (None: none does)."""
    keys: list[int] = []
    lookups: list[bool] = []
    rests: list[bytes | None] = []
    if len(rest) <= DIRECT + MOST_EDITS:
        direct, lookup = direct_keys(rest, context, edits)
        keys, lookups, rests = direct.tolist(), lookup.tolist(), [None] * len(direct)
    if len(rest) > DIRECT:
        for k, u, r in cut_keys(rest, context):
            keys.append(k)
            lookups.append(u)
            rests.append(r)
    return keys, lookups, rests
