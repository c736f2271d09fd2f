"""Archives of captured responses: written, cut into ranges anywhere, read back; members that are damaged."""

import gzip
import io
import os
import random

import pytest

from webloom.sources import archive as A


def made(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        # Bodies that hold what begins a member, and whole packed members.
        body = r.choice([b"", b"x" * r.randint(0, 3000), os.urandom(r.randint(0, 3000)), b"\x1f\x8b\x08" * r.randint(0, 50), gzip.compress(b"WARC/1.0 no"), "é😀\r\n\r\n".encode() * 5])
        rows.append((f"https://a.example/{i}", 200 + i % 5, r.choice(["", "OK", "Not here"]), {"content-type": "text/plain", f"x-{i}": f"v {i}"}, body))
    return rows


def read(data, size, most=A.MOST_BYTES):
    return [row for a in range(0, len(data), size) for row in A.responses_in(io.BytesIO(data), a, min(a + size, len(data)), most)]


@pytest.mark.parametrize("size", [1, 7, 100, 999, 5000, 1 << 30])
def test_every_record_is_read_once(size, monkeypatch):
    monkeypatch.setattr(A, "READ", 512)
    rows = made(25)
    data = b"".join(A.record_bytes(*r) for r in rows)
    if size < 100:
        data, rows = b"".join(A.record_bytes(*r) for r in rows[:4]), rows[:4]
    found = read(data, size)
    assert [(r["url"], r["status"], r["status_text"], r["headers"], r["body"]) for r in found] == rows
    assert not any(r["truncated"] or r["error"] for r in found)


def test_other_records_and_what_lies_between():
    info = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    plain = gzip.compress(b"WARC/1.0\nwarc-type: Response\nWARC-Target-URI: <https://b.example/>\nContent-Length: 43\n\nHTTP/1.1 404 Not Found\nA: 1\n  2\nA-B:c\n\nbody\n\n")
    data = info + b"junk\x1f\x8b\x08junk" + plain + b"\0" * 9 + A.record_bytes("https://c.example/", 200, None, {}, b"c")
    found = read(data, 1 << 20)
    assert [(r["url"], r["status"], r["headers"], r["body"]) for r in found] == [("https://b.example/", 404, {"a": "1 2", "a-b": "c"}, b"body"), ("https://c.example/", 200, {}, b"c")]


def test_damaged_members_are_rows_with_errors():
    parts = [A.record_bytes(*r) for r in made(6, 3)]
    broken = bytearray(parts[2])
    broken[-9:-5] = b"\0\0\0\0"
    data = b"".join([*parts[:2], bytes(broken), *parts[3:5], parts[5][:-4]])
    found = read(data, 1 << 20)
    assert [r.get("url") for r in found if not r["error"]] == [f"https://a.example/{i}" for i in (0, 1, 3, 4)]
    assert [r["error"].split(": ")[0] for r in found if r["error"]] == [f"at {len(parts[0]) + len(parts[1])}", f"at {sum(map(len, [*parts[:2], broken, *parts[3:5]]))}"]
    headless = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nnothing")
    assert read(headless, 99)[0]["error"] == "at 0: a response without a status"


def test_large_bodies_are_cut_off():
    data = A.record_bytes("https://a.example/", 200, "OK", {}, b"x" * 100_000) + A.record_bytes("https://a.example/2", 200, "OK", {}, b"y")
    found = read(data, 1 << 20, most=1000)
    assert [(len(r["body"]), r["truncated"]) for r in found] == [(1000, True), (1, False)]


def test_through_spark(spark, tmp_path):
    A.register(spark)
    rows = [*made(40, 5), (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "url string, status int, status_text string, headers map<string,string>, body binary, more int").repartition(3)
    path = f"file://{tmp_path}/archive"
    for _ in range(2):
        df.write.format("webloom_archive").mode("append").save(path)
    names = [p.name for p in (tmp_path / "archive").iterdir() if not p.name.endswith(".crc")]
    assert len(names) == 6 and all(n.startswith("part-") and n.endswith(".warc.gz") for n in names)
    read_back = spark.read.format("webloom_archive").option("range_bytes", "3000").load(path)
    assert read_back.rdd.getNumPartitions() > 6
    found = sorted((r.url, r.status, r.status_text, sorted(r.headers.items()), bytes(r.body)) for r in read_back.collect())
    wanted = [(u or "", s or 0, t or "", sorted((h or {}).items()), b or b"") for u, s, t, h, b in rows]
    assert found == sorted(wanted * 2)
    one = spark.read.format("webloom_archive").load(f"file://{tmp_path}/archive/{names[0]}")
    assert 0 < one.count() < 41
    (tmp_path / "none").mkdir()
    assert spark.read.format("webloom_archive").load(f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="use append"):
        df.write.format("webloom_archive").mode("overwrite").save(path)
