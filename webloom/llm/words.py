"""Words of whole texts as 64-bit hashes, in array operations.

A-Z are lower-cased; a word is a run of other bytes than blank and 0x09 to 0x0D of the text's UTF-8. Equal words have
equal hashes on every machine. Long texts are hashed piece by piece, so that memory follows the words, not the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_U = np.uint64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled (one to one)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LETTER[_BLANK] = 0


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15 | 5, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(1 << 16)


def _weights(place: np.ndarray) -> np.ndarray:
    """A weight for each place in a word: powers, and beyond their number powers times a number of the block."""
    weights = _POWER[place & 0xFFFF]
    if len(place) and int(place.max()) > 0xFFFF:
        block = (place >> 16).astype(np.uint64)
        weights = weights * np.where(block == 0, _U(1), mixed(block) | _U(1))
    return weights


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _piece(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8)
    inside = ~_BLANK[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    if inside[-1]:
        edge = np.concatenate([edge, [len(a)]])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    length = end - begin
    letters = a[inside]
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, length)
    return mixed(np.add.reduceat(_LETTER[letters] * _weights(place), first) + length.astype(np.uint64))


def _long_word(data: bytes) -> np.ndarray:
    """The hash of one word, piece by piece."""
    total = 0
    for a in range(0, len(data), PIECE):
        part = np.frombuffer(data[a : a + PIECE], dtype=np.uint8)
        total += int((_LETTER[part] * _weights(np.arange(a, a + len(part)))).sum(dtype=np.uint64))
    return mixed(np.array([(total + len(data)) % (1 << 64)], dtype=np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of each word, in order."""
    data = data.lower()
    if not data:
        return np.zeros(0, dtype=np.uint64)
    if len(data) <= PIECE:
        return _piece(data)
    parts, at, array = [], 0, np.frombuffer(data, dtype=np.uint8)
    while at < len(data):
        stop = min(len(data), at + PIECE)
        cut = stop
        while stop < len(data):  # up to the next blank
            found = np.flatnonzero(_BLANK[array[stop : stop + PIECE]])
            if len(found):
                stop += int(found[0])
                break
            stop = min(len(data), stop + PIECE)
        if stop - cut > PIECE:  # the last word is a long one
            blanks = np.flatnonzero(_BLANK[array[at:cut]])
            begin = at + int(blanks[-1]) + 1 if len(blanks) else at
            parts += [_piece(data[at:begin])] if begin > at else []
            parts.append(_long_word(data[begin:stop]))
        else:
            parts.append(_piece(data[at:stop]))
        at = stop
    return np.concatenate(parts)


_PLACES = mixed(np.arange(101, 165, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)


def shingles(words: np.ndarray, k: int, whole_if_short: bool = True) -> np.ndarray:
    """The hash of each run of k words, in order; fewer words are one shingle, or none."""
    if len(words) < k:
        if not len(words) or not whole_if_short:
            return np.zeros(0, dtype=np.uint64)
        k = len(words)
    total = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        total = total + words[j : len(words) - k + 1 + j] * _PLACES[j]
    return mixed(total)


def _give_back() -> None:
    """Returns freed memory to the system, since a worker is kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_size(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most_bytes of the (string or binary) column at most, one row at least."""
    for batch in batches:
        offsets = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64).cumsum()
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, (offsets[a - 1] if a else 0) + most_bytes, side="right")))
            yield batch.slice(a, b - a)
            a = b
    _give_back()


def gathered(batches: Iterator[pa.RecordBatch], column: int, least_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows in larger batches, of at least so many bytes of the column but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= least_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
