"""How often hashes occur over all rows, in a fixed number of cells: an upper bound for each hash."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from webloom.llm.words import by_size, utf8

SLICES = 64


def cell_counts(docs: DataFrame, hashes: Callable[[bytes], np.ndarray], bits: int = 20) -> np.ndarray:
    """Occurrences per cell (the top ``bits`` bits of a hash) over the column text: 2**bits numbers, however many rows.

    A task sends its cells in slices, compressed; slices are added in two steps, so that no group grows with the tasks.
    """
    width = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, dtype=np.int64)
        held, n = [], 0
        for batch in by_size(batches, 0):
            for text in batch.column(0).to_pylist():
                held.append(hashes(utf8(text)) >> np.uint64(64 - bits))
                n += len(held[-1])
                if n > 1 << 19:
                    cells += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
                    held, n = [], 0
        if n:
            cells += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
        packed = [zlib.compress(cells[i * width : (i + 1) * width].tobytes(), 1) for i in range(SLICES)]
        task = TaskContext.get().partitionId() % 256
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array(packed, pa.binary())], ["slice", "part", "cells"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(zlib.decompress(c), dtype=np.int64) for c in rows["cells"].to_pylist()), np.zeros(width, dtype=np.int64))
        return pa.table([rows["slice"].slice(0, 1), pa.array([0], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["slice", "part", "cells"])

    schema = "slice int, part int, cells binary"
    sums = docs.select("text").mapInArrow(count, schema).groupBy("slice", "part").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema).collect()
    out = np.zeros(1 << bits, dtype=np.int64)
    for r in sums:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(zlib.decompress(r["cells"]), dtype=np.int64)
    return out
