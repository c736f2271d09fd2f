"""SimHash: fingerprints word by word, links by all pairs, the index's pruning."""

import numpy as np
import pytest
import xxhash
from brute import Sets
from helpers import awkward, empty, text
from pyspark.sql import functions as F

from webloom.cut import clear_written
from webloom.llm import simhash


def plain_fingerprint(t):
    w = (t or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """component_id of rows (doc_id, fingerprint), by all pairs."""
    prints, sets = sorted({f for _, f in rows}), Sets()
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                sets.join(i, j)
    at = {f: sets.top(i) for i, f in enumerate(prints)}
    least = {}
    for d, f in rows:
        if d is not None:
            least[at[f]] = min(least.get(at[f], d), d)
    return [(d, f"{f:016x}", least.get(at[f])) for d, f in rows]


def ranked(f):
    rank = f.copy()
    for n in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(n)
    return f[np.argsort(rank)]


def found(rows):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows.collect()), key=str)


def test_hash_is_sparks(spark):
    row = spark.sql("select xxhash64('a b ç') as x").collect()[0]
    assert row.x % 2**64 == xxhash.xxh64_intdigest("a b ç".encode(), 42)


@pytest.mark.parametrize("t", [None, "", " \n", "A", "a  B", "a b\tc", "x y z X Y z", text(1, 500), "é 😀 ﬁ x y", "a\ud800b c d"])
def test_fingerprint(t):
    assert simhash.fingerprint(simhash.utf8(t)) == plain_fingerprint(t)


def test_pieces_of_a_long_text(monkeypatch):
    whole = simhash.fingerprint(text(7, 3000).encode())
    for piece in (1, 7, 100):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text(7, 3000).encode()) == whole
    monkeypatch.setattr(simhash, "PIECE", 3)
    assert simhash.fingerprint(b"  a  " + b" " * 20 + b"b ") == plain_fingerprint("a b")


def test_gray_order(spark):
    rows = spark.range(0, 256).select("id", simhash.gray_rank(F.col("id")).alias("rank")).orderBy("rank").collect()
    assert all((a.id ^ b.id).bit_count() == 1 for a, b in zip(rows, rows[1:], strict=False))
    signed = spark.sql("select explode(array(-1L, 0L, 9223372036854775807L, -9223372036854775807L - 1)) as f").select("f", simhash.gray_rank(F.col("f")).alias("rank")).collect()
    expected = np.array([r.f for r in signed], dtype=np.int64).view(np.uint64)
    for n in (1, 2, 4, 8, 16, 32):
        expected ^= expected >> np.uint64(n)
    assert [r["rank"] for r in signed] == expected.view(np.int64).tolist()


def clustered(seed, n, centres, flips):
    r = np.random.default_rng(seed)
    f = r.integers(0, 1 << 63, centres, dtype=np.int64).astype(np.uint64)[r.integers(0, centres, n)]
    for _ in range(flips):
        f ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    return np.unique(f)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_link(seed):
    f = ranked(clustered(seed, 700, 30 + 60 * seed, 3 + seed % 3))
    names = np.arange(len(f))
    index = simhash.Index(f, names)
    top, sets = simhash.link(index, index, len(f)), Sets()
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 3):
            sets.join(i, int(j))
    assert top.tolist() == [sets.top(i) for i in range(len(f))]


def test_two_indexes_of_different_heights():
    f = clustered(3, 900, 20, 3)
    a, b = ranked(f[:40]), ranked(f[40:])
    top = simhash.link(simhash.Index(a, np.arange(len(a))), simhash.Index(b, len(a) + np.arange(len(b))), len(f))
    sets = Sets()
    for i, x in enumerate(a):
        for j in np.flatnonzero(np.bitwise_count(b ^ x) <= 3):
            sets.join(i, len(a) + int(j))
    assert top.tolist() == [sets.top(i) for i in range(len(f))]


def test_dense_group_costs_its_size(monkeypatch):
    """Fingerprints around one: whole nodes that are linked already are dropped, so the pairs compared are far fewer than all."""
    seen = []
    real = simhash.differing
    monkeypatch.setattr(simhash, "differing", lambda a, b: (seen.append(np.broadcast(a, b).size), real(a, b))[1])
    f = ranked(clustered(1, 16_000, 1, 3))
    index = simhash.Index(f, np.arange(len(f)))
    assert len(np.unique(simhash.link(index, index, len(f)))) == 1
    assert sum(seen) < len(f) ** 2 / 30


@pytest.mark.parametrize("per_block", [1 << 14, 16])
def test_components_of_documents(spark, per_block):
    """Near copies by one word in many, over many blocks, against all pairs."""
    base = [text(100 + i, 400).split() for i in range(6)]
    rows = []
    for i in range(120):
        words = list(base[i % 6])
        for k in range(i // 6 % 4):
            words[(i * 7 + k * 31) % 400] = f"w{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (None, rows[0][1]), (None, rows[0][1]), (1000, rows[0][1])]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, fingerprint string, block int")
    expected = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert len({c for _, _, c in expected}) < 100
    assert found(simhash.near_copies(docs, per_block)) == sorted(expected, key=str)
    clear_written(spark)


def test_awkward_and_empty(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert found(simhash.near_copies(awkward(spark))) == sorted(plain_components([(d, plain_fingerprint(t)) for d, t in rows]), key=str)
    assert found(simhash.near_copies(empty(spark))) == []
    only_null = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert {r[2] for r in found(simhash.near_copies(only_null))} == {None}


def test_patterns_prune_blocks_before_the_shuffle(spark):
    """Blocks whose shared bits differ too often never meet; fingerprints that the other pattern stops aren't sent."""
    f = clustered(5, 4000, 1000, 2)
    prints = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fingerprint long")
    parts = {r.fingerprint: r.part for r in simhash.linked(prints, per_block=64).collect()}
    sets, order = Sets(), f.view(np.int64).tolist()
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 3):
            sets.join(i, int(j))
    of = {}
    for i, x in enumerate(order):
        assert of.setdefault(sets.top(i), parts[x]) == parts[x]
    assert len(set(of.values())) == len(of)
