"""FLAC as a media column: a codec over many streams at once, and the operators that write and read it.

The codec works on arrays with one row per frame (writing) or per run of frames between two seek points (reading), so
that Python's cost is per bit field, not per sample. Writing: mono, blocks of 192 samples, each block the cheapest of
constant, verbatim and the fixed linear predictors of order 0 to 2 with Rice-coded residuals; a seek point before every
eighth frame. Reading: any stream of up to eight channels, each by itself or two as left and side, side and right, or mid and
side, of 4 to 24 bits with constant, verbatim, fixed or linear-prediction subframes, partitioned Rice codes of either kind
with escapes, wasted bits; header and frame checksums are verified.

Very long texts: whole, like any other; a stream's frames are read a bounded number at a time. Ties: none, rows don't meet. Null text: the empty text. Empty text: 192 blanks. Equal texts give equal streams. A stream that can't be read gives an
error in its own row, the others are not affected. Repeated rows are kept; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.words import by_size, utf8

BLOCK = 192
RATE = 16_000
SEEK_FRAMES = 8
#: Frames written and bytes read at a time; they bound the arrays, not the texts.
FRAMES_AT_ONCE, BYTES_AT_ONCE = 8192, 1 << 21
#: Payload bytes that share one pass.
GROUP_BYTES = 1 << 22


class FlacError(ValueError):
    """A stream that isn't FLAC, is damaged, or uses what this reader doesn't."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for c in range(256):
        c <<= bits - 8
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, dtype=np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc8(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), dtype=np.int64)
    for t in range(int(length.max(initial=0))):
        on = t < length
        crc[on] = CRC8[crc[on] ^ buf[start[on] + t]]
    return crc


def _crc16(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows are taken longest first, so those still running are a prefix."""
    order = np.argsort(-length, kind="stable")
    at, crc, n = start[order], np.zeros(len(start), dtype=np.int64), len(start)
    ends = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
    for t, n in enumerate(ends):
        c = crc[:n]
        crc[:n] = ((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ buf[at[:n] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# Writing


def _number(i: int) -> bytes:
    """A frame number, coded as UTF-8 extended to 36 bits."""
    if i < 0x80:
        return bytes([i])
    tail = []
    room = 0x3F
    while i > room:
        tail.append(0x80 | (i & 0x3F))
        i >>= 6
        room >>= 1
    return bytes([(~(room * 2 + 1) & 0xFF) | i, *reversed(tail)])


def _frames(x: np.ndarray, numbers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all frames, and where each begins; x: a row of BLOCK signed 8-bit samples for each."""
    f = len(x)
    x = x.astype(np.int32)
    best_bits = np.full(f, 8 * BLOCK, dtype=np.int64)
    order, param = np.full(f, -1), np.zeros(f, dtype=np.int64)
    values, lengths = (x & 0xFF).astype(np.int32), np.full((f, BLOCK), 8, dtype=np.int32)
    residual = x
    for p in range(3):
        u = (residual << 1) ^ (residual >> 31)
        most = u.max(axis=1, initial=0)
        least = np.maximum(0, np.frexp(most.astype(np.float64))[1] - 5)
        for k in range(int(least.min()), 11):
            bits = (u >> k).sum(axis=1, dtype=np.int64) + u.shape[1] * (k + 1) + 8 * p + 10
            better = (bits < best_bits) & (k >= least)
            best_bits[better], order[better], param[better] = bits[better], p, k
        residual = np.diff(residual, axis=1)
    constant = (x == x[:, :1]).all(axis=1)
    order[constant] = -2
    residual = x
    for p in range(3):
        own = order == p
        if own.any():
            u, k = (residual[own] << 1) ^ (residual[own] >> 31), param[own, None].astype(np.int32)
            v, n = values[own], lengths[own]
            v[:, p:], n[:, p:] = (1 << k) | (u & ((1 << k) - 1)), (u >> k) + 1 + k
            values[own], lengths[own] = v, n
        residual = np.diff(residual, axis=1)
    lengths[constant, 1:] = 0
    # Fields after the header: subframe kind, up to two first samples, the residual's head, the samples.
    kind = np.where(order == -2, 0, np.where(order == -1, 2, 16 + 2 * order))
    head_v = np.stack([kind, x[:, 0] & 0xFF, x[:, 1] & 0xFF, param], axis=1).astype(np.int32)
    head_n = np.stack([np.full(f, 8), 8 * (order >= 1), 8 * (order >= 2), 10 * (order >= 0)], axis=1).astype(np.int32)
    for p in (1, 2):
        lengths[order == p, :p] = 0
    values, lengths = np.concatenate([head_v, values], axis=1), np.concatenate([head_n, lengths], axis=1)
    heads = [b"\xff\xf8\x10\x02" + n for n in numbers]
    head_len = np.array([len(h) + 1 for h in heads], dtype=np.int64)
    bits = lengths.sum(axis=1, dtype=np.int64)
    total = head_len + (bits + 7) // 8 + 2
    begin = np.concatenate([[0], np.cumsum(total)])
    ends = ((begin[:-1] + head_len) * 8)[:, None] + np.cumsum(lengths, axis=1, dtype=np.int64)
    raw = np.zeros(begin[-1] * 8, dtype=np.uint8)
    for j in range(11):
        on = ((values >> j) & 1).astype(bool) & (lengths > j)
        raw[ends[on] - (1 + j)] = 1
    out = np.packbits(raw)
    for n in set(head_len.tolist()):
        own = np.flatnonzero(head_len == n)
        out[begin[own][:, None] + np.arange(n - 1)] = np.frombuffer(b"".join(heads[i] for i in own), dtype=np.uint8).reshape(-1, n - 1)
    out[begin[:-1] + head_len - 1] = _crc8(out, begin[:-1], head_len - 1)
    crc = _crc16(out, begin[:-1], total - 2)
    out[begin[1:] - 2], out[begin[1:] - 1] = crc >> 8, crc & 0xFF
    return out, begin


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of a positive multiple of BLOCK bytes, kept as unsigned 8-bit samples."""
    counts = [len(p) // BLOCK for p in payloads]
    signed = np.frombuffer(b"".join(payloads), dtype=np.uint8) ^ 0x80
    rows = signed.view(np.int8).reshape(-1, BLOCK)
    numbers = [_number(i) for i in range(max(counts, default=0))]
    mine = [numbers[i] for n in counts for i in range(n)]
    parts, sizes = [], []
    for a in range(0, len(rows), FRAMES_AT_ONCE):
        data, begin = _frames(rows[a : a + FRAMES_AT_ONCE], mine[a : a + FRAMES_AT_ONCE])
        parts.append(data.tobytes())
        sizes.append(np.diff(begin))
    data, size = b"".join(parts), np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    out, at = [], 0
    for payload, n in zip(payloads, counts, strict=True):
        own = begin[at : at + n + 1] - begin[at]
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(own[i]), BLOCK) for i in range(0, n, SEEK_FRAMES))
        md5 = hashlib.md5((np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()).digest()
        small, large = int(size[at : at + n].min()), int(size[at : at + n].max())
        info = struct.pack(">HH", BLOCK, BLOCK) + small.to_bytes(3, "big") + large.to_bytes(3, "big") + ((RATE << 44) | (7 << 36) | n * BLOCK).to_bytes(8, "big") + md5
        meta = b"\x00" + len(info).to_bytes(3, "big") + info
        if len(points) < 1 << 24:
            meta += b"\x83" + len(points).to_bytes(3, "big") + points
        else:  # too long for a block: the reader goes from the start
            meta = b"\x80" + meta[1:]
        out.append(b"fLaC" + meta + data[begin[at] : begin[at + n]])
        at += n
    return out


# Reading


def _metadata(data: bytes) -> tuple[int, int, int, int, bytes, list[tuple[int, int]]]:
    """Samples, bits of each, channels, where frames begin, MD5, and seek points (sample, offset) from the first frame on."""
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, info, points = 4, None, []
    while True:
        if at + 4 > len(data):
            raise FlacError("metadata is cut off")
        last, kind, n = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            if len(body) != 34:
                raise FlacError("STREAMINFO is cut off")
            bits = int.from_bytes(body[10:18], "big")
            info = bits & ((1 << 36) - 1), ((bits >> 36) & 31) + 1, ((bits >> 41) & 7) + 1, body[18:34]
        elif kind == 3:
            points = [p[:2] for p in struct.iter_unpack(">QQH", body) if p[0] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + n
        if last:
            break
    if info is None:
        raise FlacError("no STREAMINFO")
    if not points or points[0] != (0, 0):
        points = [(0, 0)]
    return *info[:3], at, info[3], points


def decode(streams: list[bytes]) -> list[np.ndarray | FlacError]:
    """The samples of each stream (int32; a column for each channel if there are several), or why it can't be read."""
    out: list = [None] * len(streams)
    todo: list[tuple[int, int, int, int, int]] = []  # stream, first byte, end, first sample, end
    group, held = [], 0

    def run() -> None:
        nonlocal group, held
        if group:
            _decode_runs(streams, group, out)
        group, held = [], 0

    bits, digests = {}, {}
    for i, data in enumerate(streams):
        try:
            n, width, channels, start, digests[i], points = _metadata(data)
        except FlacError as e:
            out[i] = e
            continue
        bits[i], out[i] = (width, channels), np.zeros(n if channels == 1 else (n, channels), dtype=np.int32)
        points = [*points, (n, len(data) - start)]
        todo += [(i, start + a[1], start + b[1], a[0], b[0]) for a, b in zip(points, points[1:], strict=False) if b[0] > a[0]]
    for job in todo:
        group.append((*job, *bits[job[0]]))
        held += job[2] - job[1]
        if held >= BYTES_AT_ONCE:
            run()
    run()
    for i, (width, _) in bits.items():
        if isinstance(out[i], np.ndarray) and any(digests[i]):
            wide = (width + 7) // 8
            raw = out[i].astype("<i4").view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()
            if hashlib.md5(raw).digest() != digests[i]:
                out[i] = FlacError("MD5 of the samples differs")
    return out


FIXED_BLOCKS = {1: 192, **{n: 576 << (n - 2) for n in range(2, 6)}, **{n: 256 << (n - 8) for n in range(8, 16)}}
BLOCK_OF = np.array([FIXED_BLOCKS.get(n, 0) for n in range(16)], dtype=np.int64)
NUMBER_BYTES = np.array([1 if b < 0x80 else 8 - int(b ^ 0xFF).bit_length() if b >= 0xC0 else 0 for b in range(256)], dtype=np.int64)
NUMBER_BYTES[0xFF] = 0
WIDTH_OF = np.array([0, 8, 12, -1, 16, 20, 24, 32], dtype=np.int64)


class _Bits:
    """Bit positions in one buffer, read for many rows at a time."""

    def __init__(self, buf: np.ndarray) -> None:
        n = len(buf) - 8
        self.words = np.zeros(n, dtype=np.uint64)
        for j in range(8):
            self.words |= buf[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.last = (n - 1) * 8

    def window(self, pos: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position on, at the top."""
        return self.words[pos >> 3] << (pos & 7).astype(np.uint64)

    def unsigned(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return ((self.window(pos) >> np.uint64(1)) >> np.asarray(63 - n, dtype=np.uint64)).astype(np.int64)

    def signed(self, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = self.unsigned(pos, n)
        return np.where(n > 0, v - ((v >> np.maximum(n - 1, 0)) & 1) * (np.int64(1) << n), 0)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """Zero bits before the next one bit."""
        n, rest = np.zeros(len(pos), dtype=np.int64), np.arange(len(pos))
        while len(rest):
            at = pos[rest] + n[rest]
            top = (self.window(np.minimum(at, self.last)) >> np.uint64(32)).astype(np.int64)
            n[rest] += 32 - np.frexp(top.astype(np.float64))[1]
            rest = rest[(top == 0) & (at < self.last)]
        return n


def _decode_runs(streams: list[bytes], jobs: list[tuple[int, int, int, int, int, int, int]], out: list) -> None:
    """Reads each run of frames into its stream's samples in out, or puts an error there."""
    parts = [streams[i][a:b] for i, a, b, *_ in jobs]
    base = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    buf = np.concatenate([np.frombuffer(b"".join(parts), dtype=np.uint8), np.zeros(64, dtype=np.uint8)]).astype(np.int64)
    bits = _Bits(buf)
    stream = np.array([j[0] for j in jobs])
    byte, end = base[:-1].copy(), base[1:]
    sample, last = np.array([j[3] for j in jobs]), np.array([j[4] for j in jobs])
    width, channels = np.array([j[5] for j in jobs]), np.array([j[6] for j in jobs])
    live = np.ones(len(jobs), dtype=bool)

    def fail(rows: np.ndarray, why: str) -> None:
        for i in set(stream[rows].tolist()):
            if isinstance(out[i], np.ndarray):
                out[i] = FlacError(why)
        live[rows] = False

    while True:
        rows = np.flatnonzero(live & (sample < last))
        if not len(rows):
            return
        start = byte[rows]
        good = start + 6 <= end[rows]
        good &= (buf[start] == 0xFF) & ((buf[start + 1] & 0xFE) == 0xF8)
        if not good.all():
            fail(rows[~good], "no frame where one should begin")
            continue
        code, rate = buf[start + 2] >> 4, buf[start + 2] & 15
        own_width = WIDTH_OF[(buf[start + 3] >> 1) & 7]
        number = NUMBER_BYTES[buf[start + 4]]
        wide_block, wide_rate = np.where(code == 6, 1, np.where(code == 7, 2, 0)), np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
        at = start + 4 + number
        n = np.where(code == 6, buf[at] + 1, np.where(code == 7, (buf[at] << 8) + buf[at + 1] + 1, BLOCK_OF[code]))
        head = 4 + number + wide_block + wide_rate
        bps = np.where(own_width == 0, width[rows], own_width)
        kind = buf[start + 3] >> 4
        count = np.where(kind < 8, kind + 1, 2)
        good = (kind <= 10) & (count == channels[rows]) & (number > 0) & (n > 0) & (rate < 15) & (bps == width[rows]) & (start + head < end[rows])
        good &= sample[rows] + n <= last[rows]
        if not good.all():
            fail(rows[~good], "a frame header that isn't valid")
            continue
        if (bad := _crc8(buf, start, head) != buf[start + head]).any():
            fail(rows[bad], "checksum of a frame header differs")
            continue
        values, pos, bad = _channels(bits, (start + head + 1) * 8, n, bps, end[rows] * 8, kind, count)
        stop = (pos + 7) >> 3
        bad |= stop + 2 > end[rows]
        stop = np.minimum(stop, end[rows])
        bad |= _crc16(buf, start, stop - start) != (buf[stop] << 8 | buf[stop + 1])
        if bad.any():
            fail(rows[bad], "a frame is damaged or its checksum differs")
        for r in np.flatnonzero(~bad) if len(set(n.tolist())) > 1 else ():
            i = stream[rows[r]]
            if isinstance(out[i], np.ndarray):
                out[i][sample[rows[r]] : sample[rows[r]] + n[r]] = values[r, : n[r]] if out[i].ndim == values.ndim - 1 else values[r, : n[r], 0] if out[i].ndim == 1 else values[r, : n[r], : out[i].shape[1]]
        if len(set(n.tolist())) == 1:
            for r, i, a in zip(np.flatnonzero(~bad).tolist(), stream[rows][~bad].tolist(), sample[rows][~bad].tolist(), strict=True):
                if isinstance(out[i], np.ndarray):
                    out[i][a : a + values.shape[1]] = values[r] if values.ndim == 2 else values[r, :, 0] if out[i].ndim == 1 else values[r, :, : out[i].shape[1]]
        byte[rows], sample[rows] = stop + 2, sample[rows] + n


LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


def _channels(bits: _Bits, pos: np.ndarray, n: np.ndarray, bps: np.ndarray, limit: np.ndarray, kind: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _subframes, for all channels of a frame; with more than one in any, samples have a third axis."""
    most = int(count.max())
    if most == 1:
        return _subframes(bits, pos, n, bps, limit)
    x, bad, pos = np.zeros((len(pos), int(n.max()), most), dtype=np.int64), np.zeros(len(pos), dtype=bool), pos.copy()
    for c in range(most):
        own = np.flatnonzero((count > c) & ~bad)
        if len(own):
            # The difference of two channels has a bit more.
            side = (kind[own] == SIDE_RIGHT) if c == 0 else (kind[own] == LEFT_SIDE) | (kind[own] == MID_SIDE) if c == 1 else np.zeros(len(own), dtype=bool)
            values, pos[own], bad[own] = _subframes(bits, np.minimum(pos[own], bits.last), n[own], bps[own] + side, limit[own])
            x[own, : values.shape[1], c] = values
    a, b = x[:, :, 0], x[:, :, 1]
    left, right, middle = (np.flatnonzero(kind == k) for k in (LEFT_SIDE, SIDE_RIGHT, MID_SIDE))
    b[left] = a[left] - b[left]
    a[right] += b[right]
    whole = a[middle] * 2 + (b[middle] & 1)
    a[middle], b[middle] = (whole + b[middle]) >> 1, (whole - b[middle]) >> 1
    return x, pos, bad


def _subframes(bits: _Bits, pos: np.ndarray, n: np.ndarray, bps: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples, the bit after each subframe, and which rows aren't valid."""
    f, most = len(pos), int(n.max())
    x = np.zeros((f, most), dtype=np.int64)
    kind, wasted = bits.unsigned(pos, 8), np.zeros(f, dtype=np.int64)
    pos = pos + 8
    if (has := (kind & 1) == 1).any():
        wasted[has] = bits.zeros(pos[has]) + 1
        pos = pos + wasted
    width = bps - wasted
    kind = kind >> 1
    fixed, lpc = (kind >= 8) & (kind <= 12), (kind >= 32) & (kind < 64)
    bad = ~((kind <= 1) | fixed | lpc) | (width < 1)
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    bad |= order > n
    width, order = np.where(bad, 1, width), np.where(bad, 0, order)
    plain = np.where(bad, 0, np.where(kind == 0, 1, np.where(kind == 1, n, order)))  # samples kept as they are
    for i in range(int(plain.max(initial=0))):
        on = np.flatnonzero((i < plain) & (pos <= limit))
        x[on, i] = bits.signed(pos[on], width[on])
        pos[on] += width[on]
    shift, precision = np.zeros(f, dtype=np.int64), np.zeros(f, dtype=np.int64)
    own = np.flatnonzero(lpc & ~bad)
    coefficients = np.zeros((f, 33), dtype=np.int64)
    if len(own):
        precision[own] = bits.unsigned(pos[own], 4) + 1
        shift[own] = bits.signed(pos[own] + 4, np.full(len(own), 5))
        bad[own] |= (precision[own] == 16) | (shift[own] < 0)
        shift = np.maximum(shift, 0)
        pos[own] += 9
        for j in range(int(order[own].max())):
            on = own[j < order[own]]
            coefficients[on, j] = bits.signed(pos[on], precision[on])
            pos[on] += precision[on]
    coded = (fixed | lpc) & ~bad
    own = np.flatnonzero(coded)
    if len(own):
        pos[own], bad[own] = _residuals(bits, pos[own], n[own], order[own], limit[own], x, own, bad[own])
    for p in range(1, 5):
        own = np.flatnonzero(fixed & (order == p) & ~bad)
        if len(own):
            sub = x[own]
            for i in range(p, most):
                if p == 1:
                    sub[:, i] += sub[:, i - 1]
                elif p == 2:
                    sub[:, i] += 2 * sub[:, i - 1] - sub[:, i - 2]
                elif p == 3:
                    sub[:, i] += 3 * sub[:, i - 1] - 3 * sub[:, i - 2] + sub[:, i - 3]
                else:
                    sub[:, i] += 4 * sub[:, i - 1] - 6 * sub[:, i - 2] + 4 * sub[:, i - 3] - sub[:, i - 4]
            x[own] = sub
    for p in sorted(set(order[lpc & ~bad].tolist())):
        own = np.flatnonzero(lpc & (order == p) & ~bad)
        sub, by = x[own], coefficients[own, :p][:, ::-1]
        for i in range(p, most):
            sub[:, i] += (sub[:, i - p : i] * by).sum(axis=1) >> shift[own]
        x[own] = sub
    constant = (kind == 0) & ~bad
    x[constant] = x[constant, :1]
    return x << wasted[:, None], pos, bad


def _residuals(bits, pos, n, order, limit, x, own, bad):
    """Rice-coded residuals into x[own]; the bit after them, and which rows aren't valid."""
    method = bits.unsigned(pos, 2)
    parts = bits.unsigned(pos + 2, 4)
    bad = bad | (method > 1) | ((n & ((1 << parts) - 1)) != 0) | ((n >> parts) < order)
    parts = np.where(bad, 0, parts)
    pos, step = pos + 6, n >> parts
    param_bits = 4 + method
    k, raw, escaped = np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=bool)
    each = len(set(zip(n.tolist(), order.tolist(), strict=True))) > 1
    next_param, values = order.copy(), np.zeros((len(pos), x.shape[1]), dtype=np.int64)
    one = np.uint64(1)
    for i in range(int(order.min()), x.shape[1]):
        on = (i >= order) & (i < n) & ~bad & (pos <= limit) if each or bad.any() else None
        new = (next_param == i) if on is None else (next_param == i) & on
        if new.any():
            p = bits.unsigned(pos[new], param_bits[new])
            top = (1 << param_bits[new]) - 1
            pos[new] += param_bits[new]
            wide = np.where(p == top, bits.unsigned(pos[new], 5), 0)
            pos[new] += np.where(p == top, 5, 0)
            k[new], raw[new], escaped[new] = np.where(p == top, 0, p), wide, p == top
            next_param[new] = (i // step[new] + 1) * step[new]
        if on is None and not escaped.any():
            if (pos > limit).any():
                bad = bad | (pos > limit)
                continue
            w = bits.window(pos)
            top = (w >> np.uint64(32)).astype(np.int64)
            q = 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
            if (top == 0).any():
                q = bits.zeros(pos)
            low = bits.unsigned(np.minimum(pos + q + 1, bits.last), k) if int((q + k).max()) > 55 else (((w << (q + 1).astype(np.uint64)) >> one) >> (63 - k).astype(np.uint64)).astype(np.int64)
            u = (q << k) | low
            values[:, i] = (u >> 1) ^ -(u & 1)
            pos += q + 1 + k
        else:
            on = np.ones(len(pos), dtype=bool) if on is None else on
            rice, plain = np.flatnonzero(on & ~escaped), np.flatnonzero(on & escaped)
            if len(rice):
                q = bits.zeros(pos[rice])
                after = np.minimum(pos[rice] + q + 1, bits.last)
                u = (q << k[rice]) | bits.unsigned(after, k[rice])
                values[rice, i] = (u >> 1) ^ -(u & 1)
                pos[rice] = after + k[rice]
            if len(plain):
                values[plain, i] = bits.signed(pos[plain], raw[plain])
                pos[plain] += raw[plain]
    late = np.arange(x.shape[1]) >= order[:, None]
    x[own] = np.where(late, values, x[own])
    return np.minimum(pos, bits.last), bad | (pos > limit)


# Operators


def payload_of(text: str | None) -> bytes:
    """The text as UTF-8, filled up by blanks to a positive multiple of BLOCK."""
    data = utf8(text)
    return data + b" " * (BLOCK * max(1, -(-len(data) // BLOCK)) - len(data))


def feature_of(samples: np.ndarray) -> str:
    """Peak, zero crossings and mean power of the samples."""
    s = samples.astype(np.int64)
    return f"peak={int(np.abs(s).max(initial=0))} crossings={int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))} power={int((s * s).sum()) // max(1, len(s))}"


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the FLAC stream of each row of docs (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1, GROUP_BYTES):
            texts = batch.column(1).to_pylist()
            media = encode([payload_of(t) for t in texts])
            sizes = [len(utf8(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def pcm_of(samples: np.ndarray, width: int) -> bytes:
    """Samples as PCM, channels side by side: up to 8 bits unsigned, else signed and little-endian in as many bytes as needed."""
    if width <= 8:
        return (samples.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()
    return np.ascontiguousarray(samples.ravel().astype("<i4")).view(np.uint8).reshape(-1, 4)[:, : (width + 7) // 8].tobytes()


def pcm_blocks(media: DataFrame, block_samples: int = 96_000) -> DataFrame:
    """doc_id, sample_offset, n_samples, pcm (``pcm_of``), error: the streams of (doc_id, media), block by block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1, GROUP_BYTES):
            rows = []
            streams = [v or b"" for v in batch.column(1).to_pylist()]
            for key, stream, got in zip(batch.column(0).to_pylist(), streams, decode(streams), strict=True):
                if isinstance(got, FlacError):
                    rows.append((key, 0, 0, None, str(got)))
                    continue
                width = _metadata(stream)[1]
                rows += [(key, a, len(got[a : a + block_samples]), pcm_of(got[a : a + block_samples], width), None) for a in range(0, len(got), block_samples)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.string())],
                ["doc_id", "sample_offset", "n_samples", "pcm", "error"],
            )

    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, sample_offset long, n_samples long, pcm binary, error string"
    return media.select("doc_id", "media").mapInArrow(work, schema)


def media_digests(media: DataFrame) -> DataFrame:
    """What was stored, read back from the streams of (doc_id, n_bytes, media)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 2, GROUP_BYTES):
            streams = batch.column(2).to_pylist()
            rows = []
            for stream, got in zip(streams, decode(streams), strict=True):
                kept = (len(stream), hashlib.sha256(stream).hexdigest())
                if isinstance(got, FlacError):
                    rows.append((None, None, None, *kept, None, str(got)))
                    continue
                data = pcm_of(got, 8)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), *kept, feature_of(got), None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    key = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, schema)
