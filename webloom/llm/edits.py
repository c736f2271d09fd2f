"""Bit-parallel edit distances between strings."""

from __future__ import annotations

from os.path import commonprefix


def within(a: str, b: str, most: int) -> int | None:
    """The edit distance of two strings if it is at most ``most``, else None.

    Bit-parallel in a band of 2 * most + 1 diagonals: bit j of reach[d] says that, with d edits, the letters of a so far
    can be matched with j - most letters of b more than that.
    """
    if abs(len(a) - len(b)) > most:
        return None
    n = len(commonprefix([a, b]))
    a, b = a[n:], b[n:]
    n = len(commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << (j + most)
    band = (1 << (2 * most + 1)) - 1
    valid = lambda i: band & ~((1 << max(0, most - i)) - 1) & ((1 << max(0, len(b) - i + most + 1)) - 1)
    reach, ok = [], valid(0)
    for d in range(most + 1):
        reach.append(((1 << most) | (reach[-1] | reach[-1] << 1 if reach else 0)) & ok)
    for i, c in enumerate(a):
        match, ok = where.get(c, 0) >> i & band, valid(i + 1)
        below, now = 0, 0
        new = []
        for r in reach:
            now = ((r & match) | below | below >> 1 | now << 1) & ok
            below = r
            new.append(now)
        reach = new
        if not any(reach):
            return None
    last = 1 << (len(b) - len(a) + most)
    return next((d for d, r in enumerate(reach) if r & last), None)


class Pattern:
    """Myers' bit vectors of one pattern: its least edit distance to any substring of a text."""

    def __init__(self, pattern: str) -> None:
        self.n = len(pattern)
        self.where: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end in the text, the first of the least) if it is at most ``most``, else None."""
        full, top = (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, score = full, 0, self.n
        found = (self.n, 0) if self.n <= most else None
        for at, c in enumerate(text, 1):
            match = self.where.get(c, 0)
            diagonal = (((match & up) + up) ^ up) | match | down
            right, left = down | ~(diagonal | up) & full, up & diagonal
            if right & top:
                score += 1
            elif left & top:
                score -= 1
                if score <= most and (found is None or score < found[0]):
                    found = (score, at)
            right, left = right << 1 & full, left << 1 & full
            up, down = left | ~(diagonal | right) & full, right & diagonal
        return found
