"""Monotone sequences in Elias-Fano form over arrays that can be memory-mapped, queried for many positions at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SELECT = np.zeros((256, 8), dtype=np.int64)
for _b in range(256):
    for _i, _at in enumerate(j for j in range(8) if _b >> j & 1):
        _SELECT[_b, _i] = _at


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Little-endian bit string of so many low bits of each value, with eight bytes to spare."""
    if not bits or not len(values):
        return np.zeros(8, dtype=np.uint8)
    out = np.zeros((len(values) * bits + 7) // 8 + 8, dtype=np.uint8)
    step = 8 * max(1, (1 << 21) // bits)  # whole bytes at a time
    for a in range(0, len(values), step):
        part = values[a : a + step].astype("<u8").view(np.uint8).reshape(-1, 8)
        raw = np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little")
        out[a * bits // 8 : a * bits // 8 + len(raw)] = raw
    return out


_BYTES = _U(0x0101010101010101)
_TOP = _U(0x8080808080808080)


def _sums_of_bytes(x: np.ndarray) -> np.ndarray:
    """Byte b: the ones in bytes 0 to b."""
    s = x - ((x >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    return ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _BYTES


class EliasFano:
    """A monotone sequence of n numbers: ``low`` has ``bits`` low bits of each; ``high`` a one bit for each, after as many zeros as its high part.

    ``ones`` has the one bits before each 64 of ``high``, and their number at the end.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray | None = None) -> None:
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.int64) if ones is None else ones
        self.reads = np.ndarray((max(0, len(low) - 7),), dtype="<u8", buffer=low, strides=(1,))
        self._zeros: np.ndarray | None = None

    @property
    def zeros(self) -> np.ndarray:
        if self._zeros is None:
            self._zeros = 64 * np.arange(len(self.ones)) - self.ones
        return self._zeros

    def parts(self, name: str) -> tuple[dict[str, np.ndarray], dict[str, int]]:
        """Arrays and numbers to be stored, from which ``stored`` makes the sequence again."""
        return {f"{name}_low": self.low, f"{name}_high": self.high, f"{name}_ones": self.ones}, {f"{name}_n": self.n, f"{name}_bits": self.bits}

    @classmethod
    def stored(cls, name: str, found: dict) -> EliasFano:
        return cls(found[f"{name}_n"], found[f"{name}_bits"], found[f"{name}_low"], found[f"{name}_high"], found[f"{name}_ones"])

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """Of sorted values below universe."""
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        upper = (values >> _U(bits)).astype(np.int64) if bits < 64 else np.zeros(n, dtype=np.int64)
        size = (n + int(upper[-1]) + 1 if n else 1) + 63
        raw = np.zeros(size // 64 * 64, dtype=np.uint8)
        raw[upper + np.arange(n)] = 1
        return cls(n, bits, _packed(values, bits), np.packbits(raw, bitorder="little").view(np.uint64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out, at, left, shift = np.zeros(len(i), dtype=np.uint64), i.astype(np.int64) * self.bits, self.bits, 0
        while left:
            n = min(32, left)
            out |= ((self.reads[at >> 3] >> (at & 7).astype(np.uint64)) & _U((1 << n) - 1)) << _U(shift)
            at, left, shift = at + n, left - n, shift + n
        return out

    def _select(self, counts: np.ndarray, i: np.ndarray, zeros: bool) -> np.ndarray:
        """Position of the i-th one (or zero) bit; counts: how many there are before each 64."""
        word = np.searchsorted(counts, i, side="right") - 1
        x = self.high[np.minimum(word, len(self.high) - 1)]
        if zeros:
            x = ~x
        left = (i - counts[word]).astype(np.uint64)
        sums = _sums_of_bytes(x)
        # The bytes whose sums don't exceed what is left come before the bit.
        byte = np.bitwise_count((((left * _BYTES) | _TOP) - sums) & _TOP).astype(np.uint64)
        shift = byte << _U(3)
        left -= ((sums << _U(8)) >> shift) & _U(0xFF)
        return word * 64 + (shift.astype(np.int64) + _SELECT[(x >> shift) & _U(0xFF), left])

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at positions i."""
        upper = self._select(self.ones, i, False) - i
        return (upper.astype(np.uint64) << _U(self.bits)) | self._low(i) if self.bits < 64 else self._low(i)

    def successor(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first position in [begin, end) with a number of value at least, else end."""
        if not self.n:
            return end.copy()
        upper = (value >> _U(self.bits)).astype(np.int64) if self.bits < 64 else np.zeros(len(value), dtype=np.int64)
        all_zeros = int(self.zeros[-1])
        # The numbers with the same high part lie between two zeros.
        before = lambda h: np.where(h > 0, self._select(self.zeros, np.clip(h - 1, 0, all_zeros - 1), True) + 1 - h, 0)
        past = upper >= all_zeros  # beyond the largest high part
        low = np.where(past, self.n, before(np.minimum(upper, all_zeros)))
        high = np.where(past | (upper + 1 > all_zeros), self.n, before(np.minimum(upper + 1, all_zeros)))
        low, high = np.clip(low, begin, end), np.clip(high, begin, end)
        wanted = value & _U((1 << self.bits) - 1)
        going = np.flatnonzero(low < high)
        while len(going):
            mid = (low[going] + high[going]) >> 1
            less = self._low(mid) < wanted[going]
            low[going] = np.where(less, mid + 1, low[going])
            high[going] = np.where(less, high[going], mid)
            going = going[low[going] < high[going]]
        return low
