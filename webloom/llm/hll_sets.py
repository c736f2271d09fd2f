"""Distinct counts and their set algebra over sliding windows: exact, and from HyperLogLog sketches with errors.

An item (client) belongs to a set (kind) on days. For each day that has any row, and each ordered pair of kinds, A is kind_a's items in
the WINDOW days that end with the day, B is kind_b's in the WINDOW days that end LAG days before it. Calendar days count, with rows or not.

Rows are summed up to one bit mask for each item, kind and 64 days before anything is shuffled, then to one row for each item, which the calendar
bounds. An Arrow function turns these into a dense array of registers for each kind and day (sketches of the items' hashes), and
into the exact numbers of items in each window and in both windows of each pair of kinds. What tasks have found is added up, registers by their greatest.
Windows of sketches are merged as van Herk does: greatest values from the start and from the end of each block of WINDOW days, two of
which make a window wherever it begins. Estimates come from the merged registers alone: the improved raw estimator, which needs
no correction of bias, for A, B and their union; intersection and difference by inclusion and exclusion, kept within what is
possible. Errors: the delta method on these, at Z standard errors. With s the relative error of an estimate, and sketches of two sets correlated by
their Jaccard similarity, var(A and B) = s2 (U2 - A2 - B2 + 2 A B both / U) and var(A without B) = s2 (U2 - B2); what a single
register can't tell is added.

Rows with a null item, kind or time are not used. Repeated rows count once; there are no ties. A kind's name may be empty or very long.
No rows, or none used: no rows. Other columns are ignored, whatever their names. Days before 1970 have negative numbers. Nothing that grows with
the items goes through one task, the driver or a broadcast; the list of kinds, whose square the result holds for each day, does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.cut import written
from webloom.llm.words import gathered

#: Bits of a register's number; registers of a sketch; the greatest value of a register but one.
BITS = 9
REGISTERS = 1 << BITS
RANKS = 64 - BITS
#: Days of a window; days by which B's window ends earlier; standard errors that an error stands for.
WINDOW, LAG, Z = 7, 1, 3.0
#: Days of a mask, cells of items x kinds x days that are counted at a time, sketches that a task holds, parts of a sketch's sum.
SPAN, CELLS, HELD, SALTS = 64, 1 << 22, 1 << 15, 16
_U = np.uint64


# Estimates


def _sigma(x: float) -> float:
    if x == 1:
        return math.inf
    y, z, before = 1.0, x, None
    while z != before:
        x, before = x * x, z
        z, y = z + x * y, 2 * y
    return z


def _tau(x: float) -> float:
    if x in (0, 1):
        return 0.0
    y, z, before = 1.0, 1 - x, None
    while z != before:
        x, before, y = math.sqrt(x), z, y / 2
        z -= (1 - x) ** 2 * y
    return z / 3


_WEIGHT = np.array([0.0, *(2.0**-k for k in range(1, RANKS + 1)), 0.0])
_EMPTY = np.array([REGISTERS * _sigma(n / REGISTERS) for n in range(REGISTERS + 1)])
_FULL = np.array([REGISTERS * _tau(1 - n / REGISTERS) * 2.0**-RANKS for n in range(REGISTERS + 1)])
ERROR = 1.04 / math.sqrt(REGISTERS)


def estimates(registers: np.ndarray) -> np.ndarray:
    """The improved raw estimate of each row of registers; 0 where all are empty."""
    total = _WEIGHT[registers].sum(axis=1) + _EMPTY[(registers == 0).sum(axis=1)] + _FULL[(registers == RANKS + 1).sum(axis=1)]
    return REGISTERS**2 / (2 * math.log(2)) / total


def algebra(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Union, intersection and A without B of each two rows of registers: estimates and errors."""
    n_a, n_b, union = estimates(a), estimates(b), estimates(np.maximum(a, b))
    both = np.clip(n_a + n_b - union, 0, np.minimum(n_a, n_b))
    only_a = np.clip(n_a - both, 0, n_a)
    grain = union * 2 * math.log(2) / REGISTERS  # what an item that changes no register is worth
    spread = lambda variance: Z * np.sqrt(ERROR**2 * np.maximum(variance, 0) + grain**2)
    mixed = np.divide(2 * n_a * n_b * both, union, out=np.zeros_like(union), where=union > 0)
    out = {"est_union": union, "est_both": both, "est_only_a": only_a, "err_union": Z * ERROR * union}
    return out | {"err_both": spread(union**2 - n_a**2 - n_b**2 + mixed), "err_only_a": spread(union**2 - n_b**2)}


def sketch_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The register of each hash, and its value there: the place of the first one bit of the rest."""
    h = hashes.view(_U)
    rest = (h << _U(BITS)) >> _U(BITS)
    length = np.frexp(rest.astype(np.float64))[1]
    # Rounding to a float may have gained a bit.
    length -= (length > 0) & ((rest >> np.maximum(length - 1, 0).astype(_U)) == 0)
    return (h >> _U(64 - BITS)).astype(np.int64), (RANKS + 1 - length).astype(np.uint8)


# Tasks


class _Found:
    """What a task has found: registers of (kind, 64 days), items of windows, items of two windows."""

    def __init__(self) -> None:
        self.registers: dict[tuple[str, int], np.ndarray] = {}
        self.counts: dict[tuple[str, str | None, int], np.ndarray] = {}

    def add(self, names: list[str], blocks: np.ndarray, days: np.ndarray, hashes: np.ndarray) -> None:
        """days: whether an item (row) of a kind was there on each of the days of blocks, which are in order."""
        n, k, width = days.shape
        item, kind, day = np.nonzero(days)
        place, value = sketch_places(hashes)
        new = np.zeros((k, width, REGISTERS), dtype=np.uint8)
        np.maximum.at(new.reshape(-1), (kind * width + day) * REGISTERS + place[item], value[item])
        # A block that is missing before another one has no days that reach into it: blocks with the ones after them are all there.
        a = days.copy()
        length = 1
        while length < WINDOW:  # windows of 2, 4 and, by an overlap, WINDOW days
            step = min(length, WINDOW - length)
            a[:, :, step:] |= a[:, :, : width - step].copy()
            length += step
        b = np.zeros_like(a)
        b[:, :, LAG:] = a[:, :, : width - LAG]
        single = a.sum(axis=0, dtype=np.int64)
        x, y = (np.ascontiguousarray(v.transpose(2, 1, 0), dtype=np.float32) for v in (a, b))
        pairs = (x @ y.transpose(0, 2, 1)).astype(np.int64)
        for j, block in enumerate(blocks.tolist()):
            own = slice(j * SPAN, (j + 1) * SPAN)
            for p, name in enumerate(names):
                if new[p, own].any():
                    held = self.registers.setdefault((name, block), np.zeros((SPAN, REGISTERS), dtype=np.uint8))
                    np.maximum(held, new[p, own], out=held)
                for other, numbers in ((None, single[p, own]), *((names[q], pairs[own, p, q]) for q in range(k))):
                    if numbers.any():
                        key = name, other, block
                        self.counts[key] = self.counts[key] + numbers if key in self.counts else numbers

    def rows(self) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        names = ["kind_a", "kind_b", "day", "n", "registers", "salt"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        rows = [(name, None, block * SPAN + int(i), None, held[i].tobytes(), salt) for (name, block), held in self.registers.items() for i in np.flatnonzero(held.any(axis=1))]
        rows += [(name, other, block * SPAN + int(i), int(numbers[i]), None, salt) for (name, other, block), numbers in self.counts.items() for i in np.flatnonzero(numbers)]
        for i in range(0, len(rows), 4096):
            columns = zip(*rows[i : i + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Found()
    for batch in gathered(batches, 1, 1 << 22):
        lists, hashes = batch.column(1), np.asarray(batch.column(0))
        item = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        kind, block, mask = lists.flatten().flatten()
        coded = kind.dictionary_encode()
        names, kind, block, mask = coded.dictionary.to_pylist(), np.asarray(coded.indices), np.asarray(block), np.asarray(mask)
        bits = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        blocks = np.unique(np.concatenate([block, block + 1]))
        at = np.searchsorted(blocks, block)
        step = max(1, CELLS // (len(names) * len(blocks) * SPAN))
        for first in range(0, len(lists), step):
            a, b = np.searchsorted(item, [first, first + step])
            n = min(step, len(lists) - first)
            days = np.zeros((n, len(names), len(blocks), SPAN), dtype=bool)
            days[item[a:b] - first, kind[a:b], at[a:b]] = bits[a:b]
            found.add(names, blocks, days.reshape(n, len(names), -1), hashes[first : first + n])
        if len(found.registers) * SPAN > HELD or len(found.counts) * SPAN > 16 * HELD:
            yield from found.rows()
            found = _Found()
    yield from found.rows()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sketch for each kind and day of a partition."""
    held: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for kind, day, registers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = np.frombuffer(registers, np.uint8)
            held[kind, day] = np.maximum(held[kind, day], new) if (kind, day) in held else new
    kinds, days = [k for k, _ in held], [d for _, d in held]
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(days, pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], ["kind", "day", "registers"])


def _ends(rows: pa.Table) -> pa.Table:
    """Of one kind's block of WINDOW days: the greatest values from its start to each day, and from each day to its end, by the day that ends the window."""
    kind, days = rows["kind"][0].as_py(), rows["day"].to_pylist()
    first = days[0] // WINDOW * WINDOW
    own = np.zeros((WINDOW, REGISTERS), dtype=np.uint8)
    for day, registers in zip(days, rows["registers"].to_pylist(), strict=True):
        np.maximum(own[day - first], np.frombuffer(registers, np.uint8), out=own[day - first])
    from_start, to_end = np.maximum.accumulate(own), np.maximum.accumulate(own[::-1])[::-1]
    out = [(first + i, from_start[i].tobytes(), None) for i in range(WINDOW) if from_start[i].any()]
    out += [(first + i + WINDOW - 1, None, to_end[i].tobytes()) for i in range(WINDOW) if to_end[i].any()]
    return pa.table({"kind": pa.array([kind] * len(out), pa.string()), "day": pa.array([r[0] for r in out], pa.int64()), **{c: pa.array([r[i] for r in out], pa.binary()) for i, c in ((1, "from_start"), (2, "to_end"))}})


_PARTS = ("a_from_start", "a_to_end", "b_from_start", "b_to_end")
_KEEP = ("day", "kind_a", "kind_b", "n_union", "n_both", "n_only_a")
_ESTIMATES = ("est_union", "est_both", "est_only_a", "err_union", "err_both", "err_only_a")


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = bytes(REGISTERS)
    for batch in batches:
        parts = [np.frombuffer(b"".join(x or none for x in batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in _PARTS]
        found = algebra(np.maximum(parts[0], parts[1]), np.maximum(parts[2], parts[3]))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in _KEEP] + [pa.array(found[c]) for c in _ESTIMATES], [*_KEEP, *_ESTIMATES])


def window_algebra(rows: DataFrame, item: str = "client_id", kind: str = "kind", time: str = "ts") -> DataFrame:
    """day, kind_a, kind_b, exact n_union, n_both, n_only_a, and est_ and err_ of each, for every day of rows and every two kinds."""
    day = F.unix_date(F.to_date(F.col(f"`{time}`"))).cast("long")
    used = rows.select(F.col(f"`{item}`").alias("item"), F.col(f"`{kind}`").alias("kind"), day.alias("day")).dropna()
    masks = used.groupBy("item", "kind", F.floor(F.col("day") / SPAN).alias("block")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(day, {SPAN}) as int)))").alias("mask"))
    items = masks.groupBy("item").agg(F.collect_list(F.struct("kind", "block", "mask")).alias("days"))
    found = items.select(F.xxhash64("item").alias("hash"), "days").mapInArrow(_task, "kind_a string, kind_b string, day long, n long, registers binary, salt int")
    found = written(found, "hll-tasks")

    sketches = found.where("registers is not null").select(F.col("kind_a").alias("kind"), "day", "registers", "salt")
    summed = sketches.repartition("kind", "day", "salt").drop("salt").mapInArrow(_merged, "kind string, day long, registers binary")
    ends = summed.groupBy("kind", F.floor(F.col("day") / WINDOW).alias("week")).applyInArrow(_ends, "kind string, day long, from_start binary, to_end binary")
    windows = written(ends.groupBy("kind", "day").agg(F.max("from_start").alias("from_start"), F.max("to_end").alias("to_end")), "hll-windows")
    counts = written(found.where("n is not null").groupBy("kind_a", "kind_b", "day").agg(F.sum("n").alias("n")), "hll-counts")

    kinds = sketches.agg(F.array_sort(F.collect_set("kind")))
    grid = sketches.select("day").distinct().select("day", F.explode(kinds.scalar()).alias("kind_a")).select("*", F.explode(kinds.scalar()).alias("kind_b"))
    own = counts.where("kind_b is null")
    for side, later in (("a", 0), ("b", LAG)):
        sizes = own.select(F.col("kind_a").alias(f"kind_{side}"), (F.col("day") + later).alias("day"), F.col("n").alias(f"n_{side}"))
        merged = windows.select(F.col("kind").alias(f"kind_{side}"), (F.col("day") + later).alias("day"), *(F.col(c).alias(f"{side}_{c}") for c in ("from_start", "to_end")))
        grid = grid.join(sizes, [f"kind_{side}", "day"], "left").join(merged, [f"kind_{side}", "day"], "left")
    both = counts.where("kind_b is not null").withColumnRenamed("n", "n_both")
    grid = grid.join(both, ["kind_a", "kind_b", "day"], "left").fillna(0, ["n_a", "n_b", "n_both"])
    sized = grid.select("day", "kind_a", "kind_b", (F.col("n_a") + F.col("n_b") - F.col("n_both")).alias("n_union"), "n_both", (F.col("n_a") - F.col("n_both")).alias("n_only_a"), *_PARTS)
    return sized.mapInArrow(_estimated, "day long, kind_a string, kind_b string, n_union long, n_both long, n_only_a long, " + ", ".join(f"{c} double" for c in _ESTIMATES))
