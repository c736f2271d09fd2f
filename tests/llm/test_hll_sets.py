"""Distinct counts of windows: exact numbers by sets, estimates by a plain sketch, errors that hold them."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.cut import clear_written
from webloom.llm import hll_sets


def day_of(t):
    return (t - datetime(1970, 1, 1)).days


def plain(rows):
    """(day, kind_a, kind_b) with the exact sets of items."""
    used = {(c, k, day_of(t)) for c, k, t in rows if None not in (c, k, t)}
    kinds, days = sorted({k for _, k, _ in used}), sorted({d for _, _, d in used})
    window = lambda kind, end: {c for c, k, d in used if k == kind and end - 6 <= d <= end}
    return {(d, a, b): (window(a, d), window(b, d - 1)) for d in days for a in kinds for b in kinds}


def plain_estimate(hashes):
    """Ertl's estimate of a set of hashes, register by register."""
    m, q = 512, 55
    registers = [0] * m
    for h in hashes:
        bits = f"{h % 2**64:064b}"
        registers[int(bits[:9], 2)] = max(registers[int(bits[:9], 2)], (bits[9:] + "1").index("1") + 1)
    count = [registers.count(k) for k in range(q + 2)]
    z = m * hll_sets._tau(1 - count[q + 1] / m)
    for k in range(q, 0, -1):
        z = (z + count[k]) / 2
    z += m * hll_sets._sigma(count[0] / m)
    return m * m / (2 * math.log(2) * z)


def frame(spark, rows):
    return spark.createDataFrame([(c, k, t, 1, b"x", "y") for c, k, t in rows], "client_id long, kind string, ts timestamp_ntz, day int, registers binary, kind_a string")


def made(seed, n, clients, days, kinds=("a", "b", "c", "")):
    r = np.random.default_rng(seed)
    start = datetime(2024, 1, 1)
    rows = [(int(r.integers(0, clients)), kinds[int(r.integers(0, len(kinds)))], start + timedelta(days=int(r.integers(0, days)), seconds=int(r.integers(0, 86400)))) for _ in range(n)]
    return rows + rows[: n // 5] + [(None, "a", start), (1, None, start), (2, "null time", None)]


@pytest.mark.parametrize("cells", [1 << 22, 500])
def test_against_sets(spark, monkeypatch, cells):
    """Gaps, days before 1970, blocks of 64 days that are missing, an item with a third of the rows; every grain of work."""
    monkeypatch.setattr(hll_sets, "CELLS", cells)
    rows = made(1, 1500, 60, 100)
    rows += [(7, "a", datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(800)]
    rows += [(3, "b", datetime(1969, 12, 20)), (3, "a", datetime(1969, 12, 26)), (4, "b", datetime(2030, 7, 1)), (4, "c", datetime(2030, 7, 7)), (4, "b", datetime(2030, 7, 8))]
    found = {(r.day, r.kind_a, r.kind_b): r for r in hll_sets.window_algebra(frame(spark, rows)).collect()}
    expected = plain(rows)
    assert set(found) == set(expected)
    for key, (a, b) in expected.items():
        assert (found[key].n_union, found[key].n_both, found[key].n_only_a) == (len(a | b), len(a & b), len(a - b)), key
    clear_written(spark)


def test_estimates_are_of_merged_sketches(spark):
    rows = made(2, 4000, 3000, 20, ("a", "b"))
    found = {(r.day, r.kind_a, r.kind_b): r for r in hll_sets.window_algebra(frame(spark, rows)).collect()}
    hashes = {r.client_id: r.h for r in spark.range(3000).select(F.col("id").alias("client_id"), F.xxhash64("id").alias("h")).collect()}
    for key, (a, b) in list(plain(rows).items())[::7]:
        of = [plain_estimate([hashes[c] for c in s]) for s in (a, b, a | b)]
        both = min(max(of[0] + of[1] - of[2], 0), of[0], of[1])
        assert np.allclose([found[key].est_union, found[key].est_both, found[key].est_only_a], [of[2], both, of[0] - both])


def test_errors_hold(spark):
    """At sizes from a few items to far beyond the registers, nine rows of ten and more, within the bound."""
    rows = made(3, 300, 80, 60, ("few", "some")) + made(4, 60_000, 30_000, 60, ("many", "most"))
    found = hll_sets.window_algebra(frame(spark, rows)).toPandas()
    for c in ("union", "both", "only_a"):
        estimate, error = found[f"est_{c}"], found[f"err_{c}"]
        assert not estimate.isna().any() and (estimate >= 0).all()
        assert ((error >= 0) & (error <= 8 * found["est_union"] / math.sqrt(512) + 3)).all()
        assert ((estimate - found[f"n_{c}"]).abs() <= error + 1e-9).mean() >= 0.97
    empty_a = found[(found["n_union"] == found["n_both"] + 0) & (found["n_union"] == 0)]
    assert (empty_a[["est_union", "est_both", "est_only_a", "err_union"]] == 0).all().all()


def test_places_of_hashes():
    h = np.array([0, -1, 1, (1 << 55) - 1, 1 << 54, (5 << 55) | 3, (1 << 54) - 1, (1 << 54) + 1], dtype=np.int64)
    place, value = hll_sets.sketch_places(h)
    bits = [f"{int(x) % 2**64:064b}" for x in h]
    assert place.tolist() == [int(b[:9], 2) for b in bits]
    assert value.tolist() == [(b[9:] + "1").index("1") + 1 for b in bits]


def test_unbiased():
    r = np.random.default_rng(5)
    for n in (1, 10, 300, 2000, 50_000):
        sets = []
        for _ in range(60):
            place, value = hll_sets.sketch_places(r.integers(-(1 << 63), 1 << 63, n, dtype=np.int64))
            registers = np.zeros(512, dtype=np.uint8)
            np.maximum.at(registers, place, value)
            sets.append(registers)
        found = hll_sets.estimates(np.array(sets))
        assert abs(found.mean() / n - 1) < 4 * hll_sets.ERROR / math.sqrt(60) and found.std() / n < 1.5 * hll_sets.ERROR


def test_many_sketches_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hll_sets, "HELD", 64)
    rows = made(6, 600, 40, 30)
    found = {(r.day, r.kind_a, r.kind_b): (r.n_union, r.n_both) for r in hll_sets.window_algebra(frame(spark, rows)).collect()}
    assert found == {k: (len(a | b), len(a & b)) for k, (a, b) in plain(rows).items()}


def test_no_rows(spark):
    assert hll_sets.window_algebra(frame(spark, [])).count() == 0
    assert hll_sets.window_algebra(frame(spark, [(None, "a", datetime(2024, 1, 1)), (1, "a", None)])).count() == 0
    one = hll_sets.window_algebra(frame(spark, [(1, "a", datetime(2024, 1, 1))])).collect()
    assert [(r.n_union, r.n_both, r.n_only_a, round(r.est_union), r.est_both, round(r.est_only_a)) for r in one] == [(1, 0, 1, 1, 0, 1)]


def test_rows_are_summed_up_before_they_are_shuffled(spark):
    masks = hll_sets.window_algebra(frame(spark, made(7, 200, 20, 9)))
    assert masks.columns[:3] == ["day", "kind_a", "kind_b"]
    plan = masks._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
