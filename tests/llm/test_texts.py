"""Operators on single texts: exact round trips, brute force, held-out accuracy."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, empty, text
from oracle import connection
from pyspark.sql import functions as F

from webloom import cut
from webloom.llm import chat, flac, ngram_lm, pii, quality, queries, url_filter
from webloom.llm.elias_fano import EliasFano
from webloom.tables import table

SMALL = "/root/testdata/sf0.001"


# Chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\nx", "<~|end|>", "~<~~s>", "", None, "[~INST]", "a\nb"]
    roles = ["user", "assistant", "assistant", None, "system", "tool\nx%0A", "assistant", "<|turn|>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, nasty, strict=True))]
    rows += [(2, 0, "user", "only"), (3, 0, "assistant", "first"), (3, 1, "user", "last"), (None, 0, "assistant", "n"), (4, None, "assistant", "b"), (4, None, "assistant", "a"), (4, None, "assistant", "a"), (5, 0, "assistant", "long " * 200_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, example long")
    examples = chat.format_examples(df)
    got = {x.conv_id: x for x in chat.digests(examples).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    first = [x for x in examples.where("conv_id = 1").orderBy("example").collect()]
    assert [x.example for x in first] == [0, 1, 2]
    for a, b in zip(first, first[1:], strict=False):
        assert b.context.startswith(a.context + a.target)
    for x in first:
        for control in chat.CONTROL[2:]:
            assert control not in x.context + x.target
    assert chat.digests(chat.format_examples(df.limit(0))).count() == 0


def test_a_long_conversation_fits_in_memory():
    """2,400 turns of 2,000 characters, whose prefixes are 6 GB together, in a session of 2 GB."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from webloom.llm import chat
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "2g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
turns = spark.sql("select 1L as conv_id, id as turn, if(id % 2 = 0, 'user', 'assistant') as role, repeat(cast(id % 10 as string), 2000) as text from range(2400)")
r = chat.digests(chat.format_examples(turns)).collect()[0]
assert (r.n_turns, r.loss_chars, r.n_examples) == (2400, 1200 * 2000, 1200), r
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=600, capture_output=True)


def test_chat_examples_are_not_shuffled(spark):
    df = table(spark, SMALL, "conversations")
    plan = chat.digests(chat.format_examples(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange") == 1 and "Python" not in plan


# URL filters


def test_url_parts_and_list(spark):
    rows = [(1, "https://a.Example.org/en/1x?q"), (2, "http://example.org/es/"), (3, "http://x.com/fr/1"), (4, "http://com/de/#f"), (5, None), (6, "no scheme"), (7, "http://example.org"), (8, "a://b://c/d"), (9, "https://badexample.org/es/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    none = spark.createDataFrame([], "items array<string>, verdict string, lift double, confidence double, support double, rarest string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, queries.URL_RULES, none).collect()}
    assert got == {
        1: ("a.example.org", "/en/1x", "example.org/en/1", "block"),
        2: ("example.org", "/es/", "example.org/es/", "block"),
        3: ("x.com", "/fr/1", "com/fr/", "allow"),
        4: ("com", "/de/", "com/de/", "block"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("example.org", "", None, "allow"),
        8: ("b:", "//c/d", None, "allow"),
        9: ("badexample.org", "/es/", "org/", "allow"),
    }
    assert url_filter.judge(df.limit(0), queries.URL_RULES, none).count() == 0


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        host, path, key = r.choice(["spam", "shop", "news"]), r.choice(["win", "blog"]), r.choice(["ref", "page"])
        bad = (host == "spam" and path == "win" and r.random() < 0.95) or r.random() < 0.05
        rows.append((i, f"https://{host}.net/{path}/{i}?{key}=1", "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    items = {x.page_id: frozenset(x["items"]) for x in df.select("page_id", url_filter.items_of(df.url).alias("items")).collect()}
    verdict = {i: v for i, _, v in rows}
    counts, hits = Counter(), Counter()
    from itertools import combinations

    for i, s in items.items():
        for n in range(1, len(s) + 1):
            for c in combinations(sorted(s), n):
                counts[c] += 1
                hits[c, verdict[i]] += 1
    wanted = {(c, v): n / counts[c] for (c, v), n in hits.items() if n >= 20 and n / counts[c] >= 0.8}
    shorter = lambda c, v: any((x, v) in wanted and wanted[x, v] >= wanted[c, v] for n in range(1, len(c)) for x in combinations(c, n))
    kept = {k: p for k, p in wanted.items() if not shorter(*k)}
    mined = url_filter.mine(df.select("url", "verdict"), 20 / 400, 0.8, 20)
    found = {(tuple(x["items"]), x.verdict): x.confidence for x in mined.collect()}
    assert found.keys() == kept.keys() and all(abs(found[k] - kept[k]) < 1e-9 for k in kept) and ("host:spam", "path:win") in {k[0] for k in kept}
    share = {v: sum(x == v for x in verdict.values()) / len(rows) for v in ("block", "allow")}
    # Columns of names that the operator uses itself.
    pages = df.selectExpr("page_id", "url", "1 as rule", "2 as url_items", "3 as best", "4 as by_list", "5 as bucket", "6 as host")
    for most in (1000, 0):  # looked up in one value, and joined
        judged = {x.page_id: x for x in url_filter.judge(pages, [], mined, most_rules=most).collect()}
        for i, s in items.items():
            fits = [(p / share[v], p, v) for (c, v), p in kept.items() if set(c) <= s]
            assert (judged[i].lift, judged[i].confidence, judged[i].verdict) == (pytest.approx(max(fits)[0]), pytest.approx(max(fits)[1]), max(fits)[2]) if fits else judged[i].verdict == "allow"
    lifted = url_filter.mine(df.select("url", "verdict"), 20 / 400, 0.8, 20, min_lift=2)
    assert {x.verdict for x in lifted.collect()} == {"block"}
    plan = url_filter.judge(pages, [], mined)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_mined_verdicts_on_held_out_urls(spark):
    """Rules learned from four fifths of the URLs that the list decides, against the list on the rest."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")
    rows = pages.withColumn("listed", url_filter.listed_rule(pages.url, queries.URL_RULES)[1]).where("listed is not null").withColumn("held", F.crc32(F.col("url").cast("binary")) % 5 == 0)
    mined = url_filter.mine(rows.where("not held").select("url", F.col("listed").alias("verdict")), min_support=0.002, min_confidence=0.8, min_lift=1.2)
    held = rows.where("held")
    judged = {x.page_id: x.verdict for x in url_filter.judge(held, [], mined).collect()}
    pairs = [(x.listed, judged[x.page_id]) for x in held.collect()]
    hit = sum(p == ("block", "block") for p in pairs)
    precision, recall = hit / max(1, sum(b == "block" for _, b in pairs)), hit / sum(a == "block" for a, _ in pairs)
    print("held out:", len(pairs), "precision", precision, "recall", recall)
    assert precision > 0.9 and recall > 0.5
    judged = queries.op5_url_filter(spark, "/root/testdata/sf0.1").where("rule is null and verdict = 'block'")
    assert judged.count() > 50


def test_mining_without_labels(spark):
    df = spark.createDataFrame([], "url string, verdict string")
    assert url_filter.mine(df, 0.01, 0.5).count() == 0


# FLAC: a reader of one stream, bit by bit, and writers of what the array writer never writes


class Bits:
    def __init__(self, data):
        self.data, self.at = data, 0

    def get(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | (self.data[self.at >> 3] >> (7 - (self.at & 7))) & 1
            self.at += 1
        return v

    def signed(self, n):
        v = self.get(n)
        return v - (1 << n) if n and v >> (n - 1) else v


def slow_decode(data):
    at = 4
    while True:
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            total = int.from_bytes(data[at + 14 : at + 22], "big") & ((1 << 36) - 1)
        at += 4 + n
        if last:
            break
    out, b = [], Bits(data)
    b.at = at * 8
    while len(out) < total:
        assert b.get(14) == 0x3FFE and b.get(2) == 0
        code, _, channel, width, _ = b.get(4), b.get(4), b.get(4), b.get(3), b.get(1)
        assert channel == 0
        lead = b.get(8)
        for _ in range(max(0, 8 - (lead ^ 255).bit_length() - 1)):
            b.get(8)
        n = {1: 192}.get(code) or (b.get(8) + 1 if code == 6 else b.get(16) + 1)
        b.get(8)
        bps = {1: 8, 4: 16}[width]
        assert b.get(1) == 0
        kind, wasted = b.get(6), b.get(1)
        assert not wasted
        if kind == 0:
            x = [b.signed(bps)] * n
        elif kind == 1:
            x = [b.signed(bps) for _ in range(n)]
        else:
            order = kind - 8 if kind < 16 else kind - 31
            x = [b.signed(bps) for _ in range(order)]
            coefficients, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 16 else None, 0
            if kind >= 32:
                precision, shift = b.get(4) + 1, b.get(5)
                coefficients = [b.signed(precision) for _ in range(order)]
            method, parts = b.get(2), b.get(4)
            for p in range(1 << parts):
                k = b.get(4 + method)
                raw = b.get(5) if k == (15, 31)[method] else None
                for _ in range((n >> parts) - (order if p == 0 else 0)):
                    if raw is not None:
                        e = b.signed(raw)
                    else:
                        q = 0
                        while not b.get(1):
                            q += 1
                        u = q << k | b.get(k)
                        e = u >> 1 ^ -(u & 1)
                    x.append(e + (sum(c * v for c, v in zip(coefficients, reversed(x), strict=False)) >> shift))
        out += x
        b.at = (b.at + 7) // 8 * 8
        b.get(16)
    return out


def crc(data, poly, bits):
    c = 0
    for byte in data:
        c ^= byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) else 0)) & ((1 << bits) - 1)
    return c


def frame(i, n, body_bits, width=1, channels=0):
    head = b"\xff\xf8" + bytes([0x70, channels << 4 | width << 1]) + bytes([i]) + (n - 1).to_bytes(2, "big")
    head += bytes([crc(head, 0x07, 8)])
    body_bits += "0" * (-len(body_bits) % 8)
    data = head + int(body_bits, 2).to_bytes(len(body_bits) // 8, "big")
    return data + crc(data, 0x8005, 16).to_bytes(2, "big")


def stream(frames, total, bits=8, channels=1):
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + ((16000 << 44) | (channels - 1) << 41 | ((bits - 1) << 36) | total).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


def two(v, n):
    return format(v & ((1 << n) - 1), f"0{n}b") if n else ""


def rice(values, k):
    return "".join("0" * ((u := (2 * v if v >= 0 else -2 * v - 1)) >> k) + "1" + two(u, k) for v in values)


def test_flac_writes_what_a_plain_reader_reads():
    for s in ["", "a", "hello world " * 40, text(1, 300), "é😀" * 100, "x" * 5000]:
        p = flac.payload_of(s)
        (data,) = flac.encode([p])
        assert bytes(v + 128 for v in slow_decode(data)) == p
    many = [flac.payload_of(text(i, i * 7)) for i in range(60)]
    for p, got in zip(many, flac.decode(flac.encode(many)), strict=True):
        assert (got.astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == p


@pytest.mark.parametrize("bits", [8, 16])
def test_flac_reads_other_subframes(bits):
    r, width = random.Random(1), {8: 1, 16: 4}[bits]
    limit, cases = 1 << (bits - 2), []
    n = 32
    noise = [r.randrange(-limit // 8, limit // 8) for _ in range(n)]
    # Linear prediction of order 3, two partitions, one of them escaped; five-bit parameters.
    coefficients, shift = [9, -5, 2], 3
    residual = [v // 16 for v in noise[3:]]
    body = "0" + two(32 + 2, 6) + "0" + "".join(two(v, bits) for v in noise[:3]) + two(5 - 1, 4) + two(shift, 5) + "".join(two(c, 5) for c in coefficients)
    body += "01" + "0001" + two(4, 5) + rice(residual[:13], 4) + two(31, 5) + two(bits, 5) + "".join(two(v, bits) for v in residual[13:])
    cases.append(body)
    # Fixed orders 3 and 4; a long run of zeros in a code.
    for order in (3, 4):
        small = [r.choice([0, 1, -1, 40]) for _ in range(n - order)]
        cases.append("0" + two(8 + order, 6) + "0" + "".join(two(v, bits) for v in noise[:order]) + "00" + "0000" + two(0, 4) + rice(small, 0))
    cases.append("0" + two(0, 6) + "0" + two(-3, bits))
    cases.append("0" + two(1, 6) + "0" + "".join(two(v, bits) for v in noise))
    data = stream([frame(i, n, b, width) for i, b in enumerate(cases)], n * len(cases), bits)
    (got,) = flac.decode([data])
    assert got.tolist() == slow_decode(data)


@pytest.mark.parametrize("bits", [8, 16])
def test_flac_reads_channels(spark, bits):
    """Two channels in each of the four ways, three by themselves, next to a mono stream; and their PCM."""
    r, width, n = random.Random(2), {8: 1, 16: 4}[bits], 40
    draw = lambda: [r.randrange(-(1 << bits - 1), 1 << bits - 1) for _ in range(n)]
    plain = lambda x, b: "0" + two(1, 6) + "0" + "".join(two(v, b) for v in x)
    first = lambda x, b: "0" + two(9, 6) + "0" + two(x[0], b) + "00" + "0000" + two(7, 4) + rice([q - p for p, q in zip(x, x[1:], strict=False)], 7)
    frames, wanted = [], []
    for i, kind in enumerate([1, 8, 9, 10, 10]):
        left, right = draw(), draw()
        side = [a - b for a, b in zip(left, right, strict=True)]
        bodies = {1: (left, right), 8: (left, side), 9: (side, right), 10: ([(a + b) >> 1 for a, b in zip(left, right, strict=True)], side)}[kind]
        wide = {1: (0, 0), 8: (0, 1), 9: (1, 0), 10: (0, 1)}[kind]
        frames.append(frame(i, n, "".join((first if i % 2 else plain)(x, bits + w) for x, w in zip(bodies, wide, strict=True)), width, kind))
        wanted += zip(left, right, strict=True)
    three = [draw() for _ in range(3)]
    one = draw()
    streams = [stream(frames, 5 * n, bits, 2), stream([frame(0, n, plain(one, bits), width)], n, bits), stream([frame(0, n, "".join(plain(x, bits) for x in three), width, 2)], n, bits, 3)]
    both, mono, third = flac.decode(streams)
    assert both.tolist() == [list(x) for x in wanted] and mono.tolist() == one and third.T.tolist() == three
    damaged = bytearray(streams[0])
    damaged[-30] ^= 1
    assert isinstance(flac.decode([bytes(damaged)])[0], flac.FlacError)
    df = spark.createDataFrame([(1, bytearray(streams[0]))], "doc_id long, media binary")
    rows = sorted(flac.pcm_blocks(df, 64).collect(), key=lambda x: x.sample_offset)
    flat = [v for x in wanted for v in x]
    assert b"".join(bytes(x.pcm) for x in rows) == (bytes(v + 128 for v in flat) if bits == 8 else b"".join(v.to_bytes(2, "little", signed=True) for v in flat))
    assert [(x.sample_offset, x.n_samples) for x in rows] == [(0, 64), (64, 64), (128, 64), (192, 8)]


def test_flac_wasted_bits():
    x = [v * 4 for v in range(-8, 8)]
    body = "0" + two(1, 6) + "1" + "01" + "".join(two(v // 4, 6) for v in x)
    assert flac.decode([stream([frame(0, 16, body)], 16)])[0].tolist() == x


def test_damaged_flac(spark):
    (good,) = flac.encode([flac.payload_of(text(3, 200))])
    bad = bytearray(good)
    bad[-20] ^= 4
    wrong_md5 = bytearray(good)
    wrong_md5[30] ^= 1
    found = flac.decode([bytes(bad), good, good[:-1], b"", b"fLaC", bytes(wrong_md5)])
    assert isinstance(found[1], np.ndarray) and all(isinstance(f, flac.FlacError) for i, f in enumerate(found) if i != 1)
    df = spark.createDataFrame([(1, bytearray(bad)), (2, bytearray(good)), (3, None)], "doc_id long, media binary")
    rows = flac.pcm_blocks(df, 500).collect()
    assert {r.doc_id for r in rows if r.error} == {1, 3}
    own = sorted((r.sample_offset, bytes(r.pcm)) for r in rows if r.doc_id == 2)
    assert b"".join(p for _, p in own) == flac.payload_of(text(3, 200)) and [a for a, _ in own] == list(range(0, 500 * len(own), 500))


def test_flac_query(spark):
    docs = awkward(spark)
    given = sorted((x.doc_id, x.text) for x in docs.collect() if x.doc_id is not None and x.doc_id > 1)
    got = {x.doc_id: x for x in flac.media_digests(flac.with_media(docs)).collect()}
    for d, t in given:
        p = flac.payload_of(t)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32, got[d].error) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), None)
    assert flac.media_digests(flac.with_media(docs)).count() == docs.count()
    assert flac.media_digests(flac.with_media(empty(spark))).count() == 0


# Quality


def test_quality(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality.classify(docs, labels.selectExpr("doc_id", "quality as label"))
    both = rows.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(both) > 50 and sum(r.predicted == r.quality for r in both) / len(both) > 0.95
    again = quality.classify(docs, labels.selectExpr("doc_id", "quality as label"))
    assert rows.exceptAll(again).count() == 0


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (None, 0), (6, None), (7, 2), (1, 1)], "doc_id long, label int")
    for known in (labels, labels.limit(0), labels.where("label = 1")):
        rows = quality.classify(docs, known).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 5)}) == 1
    kept = quality.accepted(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.classify(empty(spark), labels).count() == 0 and quality.accepted(empty(spark), labels).count() == 0


def test_quality_scores_equal_brute_force(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {x.doc_id: x.score for x in quality.classify(docs, labels.selectExpr("doc_id", "quality as label")).collect()}
    assert got == pytest.approx(brute.quality_scores(spark, docs, labels), abs=1e-4)


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert y.tolist() == sorted(y) and y.tolist() == [0.0, 0.5]


# Personal data


def slow_spans(s):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans():
    r = random.Random(1)
    for _ in range(20_000):
        s = "".join(r.choice("ab@@..1234567890 0 -+()é\n%") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(s) == slow_spans(s)
    assert pii.base_spans("4111 1111 1111 1111 x") == [(2, 0, 19)]
    for hard in ("1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1(" * 50_000, "a" * 200_000):
        pii.base_spans(hard)


def test_contexts_find_other_forms(spark):
    r = random.Random(2)
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    rows = [(50 + i, f"{text(i, 5)} telephone: +1 {digits(3)} {digits(3)} {digits(4)} {text(i + 500, 4)}") for i in range(40)]
    rows += [(100 + i, f"{text(i, 5)} telephone: {digits(3)} {digits(3)} {digits(4)} then {text(i + 700, 4)}") for i in range(5)]
    rows += [(200 + i, f"{text(i, 5)} number {digits(3)} {digits(3)} {digits(4)} then {text(i + 900, 4)}") for i in range(30)]
    docs = awkward(spark, rows)
    got = {x.doc_id: x for x in pii.digests(pii.find(docs)).collect() if x.doc_id is not None}
    for d, t in rows:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in slow_spans(t))
        assert got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (got[d].spans == base) == (not 100 <= d < 200)
        if 100 <= d < 200:
            start = t.index("telephone: ") + 11
            assert got[d].spans == f"phone:{start}:{start + 12}" and got[d].n_phone == 0
    assert pii.find(docs).count() == docs.count() and pii.find(empty(spark)).count() == 0


def test_phrases_on_both_sides_and_secrets(spark):
    """Patterns of several words, of which the last is common, words after a span, and labels that introduce secrets of another form."""
    r = random.Random(4)
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    number = lambda: f"{digits(3)} {digits(3)} {digits(4)}"
    rows = [(1000 + i, f"look at {text(i, 4)} at {text(i + 40, 2)}, call me at +1 {number()} soon {text(i + 500, 3)} at") for i in range(30)]
    rows += [(1100 + i, f"{text(i, 3)} call me at {number()}. {text(i, 3)}") for i in range(4)]
    rows += [(1200 + i, f"{text(i, 3)} {text(i + 90, 1)} +1 {number()} office hours only {text(i, 2)}") for i in range(12)]
    rows += [(1300 + i, f"{text(i, 3)} ({digits(3)}) {digits(3)}-{digits(4)} office hours only") for i in range(3)]
    rows += [(1400 + i, f'{text(i, 2)}\nkey = "{hashlib.sha256(bytes([i])).hexdigest()[:40]}" {text(i, 2)}') for i in range(12)]
    rows += [(1500 + i, f'{text(i, 2)}\nkey = "{hashlib.md5(bytes([i])).hexdigest()[:30].upper()}" {text(i, 2)}') for i in range(3)]
    rows += [(1600 + i, f"commit {hashlib.sha256(bytes([i, 7])).hexdigest()[:40]} at {number()} {text(i, 2)}") for i in range(3)]
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, row int, kind string")
    got = {x.doc_id: x for x in pii.digests(pii.find(docs)).collect()}
    for d, t in rows:
        spans = [x.split(":") for x in got[d].spans.split(",") if x]
        base = [[pii.KINDS[k], str(a), str(b)] for k, a, b in slow_spans(t)]
        values = [(k, t[int(a) : int(b)]) for k, a, b in spans if [k, a, b] not in base]
        if 1100 <= d < 1200 or 1300 <= d < 1400:
            assert len(values) == 1 and values[0][0] == "phone" and values[0][1].strip("0123456789 ()-") == "" and len(values[0][1]) >= 12, (t, values)
        elif 1400 <= d < 1600:
            assert values == [("secret", t.split('"')[1])]
        else:
            assert values == []


def test_secrets_of_real_rows(spark):
    """What is added is what stands after ``token =``, all of it."""
    folder = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    wanted = {(d, m.start(1), m.end(1)) for d, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    added = pii.find(table(spark, folder, "documents")).select("doc_id", F.explode("added").alias("a")).select("doc_id", "a.*").collect()
    assert {(r.doc_id, r.start, r.end) for r in added} == wanted and {r.kind for r in added} == {pii.SECRET} and len(wanted) > 100


def test_bootstrap_equals_brute_force(spark):
    r = random.Random(5)
    edges = {}
    for i in range(120):
        kind = r.choice([-1, -1, -1, pii.PHONE, pii.CARD])
        for p in r.sample(range(12), r.randint(1, 3)):
            edges[p, i] = (kind, r.randint(1, 3))
    totals = {p: sum(n for (q, _), (_, n) in edges.items() if q == p) + r.choice([0, 5, 40]) for p in range(12)}
    rows = [(p, p + 100, i, kind, n) for (p, i), (kind, n) in edges.items()]
    found = spark.createDataFrame(rows, "pattern long, gram long, instance long, seed int, n long")
    counted = spark.createDataFrame([(p + 100, t) for p, t in totals.items()], "gram long, total long")
    seeds = {(i, kind): 1.0 for (_, i), (kind, _) in edges.items() if kind >= 0}
    trust = dict(seeds)
    for _ in range(3):
        share = {}
        for p in range(12):
            for kind in (pii.CARD, pii.PHONE):
                own = [(n, trust[i, kind]) for (q, i), (_, n) in edges.items() if q == p and (i, kind) in trust]
                if sum(t >= 0.5 for _, t in own) >= 4:
                    share[p, kind] = min(0.999, sum(n * t for n, t in own) / totals[p])
        said = {}
        for p, i in edges:
            for kind in (pii.CARD, pii.PHONE):
                if (p, kind) in share:
                    said[i, kind] = 1 - (1 - said.get((i, kind), 0.0)) * (1 - share[p, kind])
        trust = said | seeds
    got = {(x.instance, x.kind): x.trust for x in pii.bootstrap(found, counted, 3, 4).collect()}
    assert got == pytest.approx(said) and len(said) > 50


def test_scan_of_hard_texts():
    for hard in ("1 " * 100_000, "(at)" * 50_000, "a" * 300_000 + " 1", "a1=" * 60_000, "1" * 200_000, "=" * 200_000 + "1", "x:" * 100_000 + " 5"):
        pii.scanned(hard)
    base, found = pii.scanned("ring Tel:(555) 123-4567, or jane (at) mail (dot) com. v2")
    assert base == [] and {(f["start"], f["end"], f["whole"]) for f in found} >= {(9, 23, True), (28, 52, True)}


# Language model


def test_elias_fano():
    r = np.random.default_rng(1)
    for t in range(150):
        n, u = int(r.integers(0, 300)), 2 ** int(r.integers(1, 64))
        v = np.sort(r.integers(0, u if t % 3 else max(2, u // 1000), n, dtype=np.uint64))
        e = EliasFano.of(v, u)
        if n:
            i = r.integers(0, n, 50)
            assert (e.at(i) == v[i]).all()
        q = np.concatenate([r.integers(0, u, 60, dtype=np.uint64), r.choice(v, 20) if n else np.zeros(0, dtype=np.uint64)])
        a = r.integers(0, n + 1, len(q))
        b = np.array([r.integers(x, n + 1) for x in a])
        assert (e.successor(q, a, b) == [x + np.searchsorted(v[x:y], z) for z, x, y in zip(q, a, b, strict=True)]).all()


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


class Counted:
    """The model by plain counts."""

    def __init__(self, texts):
        self.one = Counter(w for t in texts for w in t)
        self.two = Counter(p for t in texts for p in zip(t, t[1:], strict=False))
        self.three = Counter(p for t in texts for p in zip(t, t[1:], t[2:], strict=False))
        self.total, self.distinct = sum(self.one.values()), len(self.one)
        self.d = min(0.95, max(0.05, sum(c == 1 for c in self.one.values()) / self.distinct))
        self.follow, self.follow2 = Counter(a for a, _ in self.two), Counter((a, b) for a, b, _ in self.three)

    def p(self, w, *before):
        """before: the context, the nearest word first."""
        if not before or before[0] not in self.one:
            return max(0, self.one[w] - self.d) / self.total + self.d * self.distinct / self.total / (self.distinct + 1)
        v, plain = before[0], self.p(w)
        of = self.one[v]
        p = max(0, self.two[v, w] - 0.75) / of + (1 - (self.two_mass(v)) / of) * plain
        if len(before) > 1 and (uv := (before[1], v)) in self.two:
            p = max(0, self.three[(*uv, w)] - 0.75) / self.two[uv] + 0.75 * self.follow2[uv] / self.two[uv] * p
        return p

    def two_mass(self, v):
        return self.one[v] - 0.75 * self.follow[v] if self.follow[v] else 0

    def score(self, t):
        return sum(math.log10(self.p(w, *reversed(t[max(0, i - 2) : i]))) for i, w in enumerate(t))


HELD = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0


@pytest.mark.parametrize("hot", [ngram_lm.HOT, 10])
def test_ngram_scores(spark, hot):
    docs = awkward(spark, [(100 + i, text(i % 40, 30 + i % 7)) for i in range(150)])
    given = [(x.doc_id, x.text) for x in docs.collect()]
    rows = ngram_lm.scores(docs, hot=hot).collect()
    assert len(rows) == len(given)
    model = Counted([tokens(t) for d, t in given if not HELD(d)])
    assert hot > 10 or sum(c > hot for c in model.one.values()) > 5
    by = {}
    for d, t in given:
        by.setdefault(d, []).append(t)
    for x in rows:
        options = by[x.doc_id]
        t = next(tokens(o) for o in options if len(tokens(o)) == x.n_tokens)
        base = sum(math.log10((model.one[w] + 0.1) / (model.total + 0.1 * (model.distinct + 1))) for w in t)
        assert (x.held_out, x.n_known, x.train_tokens) == (HELD(x.doc_id), sum(w in model.one for w in t), model.total)
        assert x.base_score == pytest.approx(base, rel=1e-9) and x.score == pytest.approx(model.score(t), abs=0.02 * len(t))
    assert ngram_lm.scores(empty(spark)).count() == 0


def test_probabilities_sum_to_one(spark):
    """Over all known words, the end and one unknown word, after any context."""
    texts = [text(i, 25) for i in range(60)]
    folder = ngram_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    trie, model = ngram_lm.Trie(folder), Counted([tokens(t) for t in texts])
    words = [w.decode() for w in model.one if w is not None]
    first = texts[0].split()
    for context in ([], first[:1], first[:2], ["unheard"], [first[3], "unheard"], ["unheard", first[3]], [first[0], first[9]]):
        before = ngram_lm.score_texts(trie, [" ".join([*context, w]) for w in [*words, "novel"]])[3]
        end = ngram_lm.score_texts(trie, [" ".join(context)])[3][0]
        # Each score ends with an end token's; the word's own is what a longer text adds to it.
        begin = 0.0
        for i, w in enumerate(context):
            begin += math.log10(model.p(w.encode(), *(x.encode() for x in reversed(context[max(0, i - 2) : i]))))
        total = 10 ** (end - begin)
        for w, s in zip([*words, "novel"], before, strict=True):
            total += 10 ** (s - begin - math.log10(model.p(None, w.encode(), *(x.encode() for x in context[-1:]))))
        assert total == pytest.approx(1, abs=0.04), context


def test_gibberish_scores_below_prose(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    r = random.Random(3)
    made = [(i, " ".join("".join(r.choice("bcdfgklmnp") for _ in range(9)) for _ in range(200))) for i in range(-200, 0) if HELD(i)]
    rows = ngram_lm.scores(docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))).collect()
    rate = lambda x: x.score / x.n_tokens
    prose = sorted(rate(x) for x in rows if x.held_out and x.doc_id >= 0 and x.n_tokens > 50)
    learned = [rate(x) for x in rows if not x.held_out and x.doc_id >= 0 and x.n_tokens > 50]
    nonsense = [rate(x) for x in rows if x.doc_id < 0 and x.held_out]
    assert nonsense and max(nonsense) < prose[len(prose) // 10]
    assert sum(learned) / len(learned) > sum(prose) / len(prose)


def test_lm_columns_equal_sql(spark):
    wanted = """
with t as (select doc_id, crc.c % 10 = 0 as held_out, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), chr(10))) as w
  from documents join crc using (doc_id)),
counts as (select w, count(*) as c from t where not held_out group by w),
sums as (select sum(c) as n, count(*) as v from counts)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n)::bigint as train_tokens,
  sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))) as base_score
from t left join counts using (w) cross join sums group by doc_id, held_out order by doc_id"""
    con = connection()
    ids = [r[0] for r in con.sql("select doc_id from documents").fetchall()]
    con.register("crc", pa.table({"doc_id": ids, "c": [zlib.crc32(str(i).encode()) for i in ids]}))
    wanted = con.sql(wanted).fetchall()
    got = sorted(tuple(x[:6]) for x in queries.op4_ngram_lm(spark, SMALL).collect())
    assert [x[:5] for x in got] == [x[:5] for x in wanted]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in wanted])


def test_listing_fewer_ngrams(spark):
    """What isn't listed is left to the shorter contexts, and the trie is gone when scores are there."""
    docs = spark.createDataFrame([(i, text(i % 30, 20)) for i in range(60)], "doc_id long, text string")
    for least in (1, 2, 100):
        assert all(r.score < 0 for r in ngram_lm.scores(docs, least=least).collect())
    where = cut.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(where))
    assert ngram_lm.scores(docs).count() == 60
    assert not [n for n in set(os.listdir(where)) - before if n.startswith("trie-")]


def test_no_training_texts(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = ngram_lm.scores(docs).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in rows) and len(rows) == 2


def test_shards_of_hashes():
    r = np.random.default_rng(1)
    h = np.sort(np.concatenate([r.integers(0, 1 << 64, 500, dtype=np.uint64, endpoint=False), np.array([0, 1, (1 << 64) - 1], dtype=np.uint64)]))
    for shards in (1, 4, 7, 1000, 8_000_003, (1 << 32) - 1):
        assert ngram_lm.shard_of(h, shards).tolist() == [int(x) * shards >> 64 for x in h]
        edges = np.array([b for s in r.integers(1, shards, 50).tolist() for b in (ngram_lm.shard_base(s, shards) - 1, ngram_lm.shard_base(s, shards))] if shards > 1 else [], dtype=np.uint64)
        assert all(ngram_lm.shard_base(int(s), shards) <= int(x) < ngram_lm.shard_base(int(s) + 1, shards) for s, x in zip(ngram_lm.shard_of(edges, shards), edges, strict=True))


def test_words_of_very_many_shards():
    """A group's words cost what they are, not what shards there are: a million shards, of which 300 are met."""
    import time

    from webloom.llm.elias_fano import EliasFano

    shards = 1_000_000
    r = np.random.default_rng(2)
    known = np.unique(r.integers(0, 1 << 64, 300, dtype=np.uint64, endpoint=False))
    trie = object.__new__(ngram_lm.Trie)
    trie.shards, trie.first, opened = shards, np.arange(shards, dtype=np.int64), []

    def part(name):
        s = int(name.removeprefix("words-"))
        opened.append(s)
        base, end = ngram_lm.shard_base(s, shards), ngram_lm.shard_base(s + 1, shards)
        own = known[(known >= np.uint64(base)) & (known <= np.uint64(end - 1))]
        ef = EliasFano.of(own - np.uint64(base), end - base)
        stored = {"word_n": ef.n, "word_bits": ef.bits, "word_low": ef.low, "word_high": ef.high, "word_ones": ef.ones}
        return stored | {"counts": np.full(len(own), 5, dtype=np.int64)}

    trie.part = part
    asked = np.sort(np.concatenate([known, known + np.uint64(1)]))
    began = time.perf_counter()
    number, count = trie.words(asked)
    assert time.perf_counter() - began < 1 and len(opened) <= 2 * len(known)
    assert ((number >= 0) == np.isin(asked, known)).all() and (count == np.where(np.isin(asked, known), 5, 0)).all()


def test_rules_of_tables_with_clashing_columns(spark):
    """Extra columns named like those that mining and judging make change nothing."""
    rows = [(i, f"https://{'bad' if i % 2 else 'good'}.example/{i % 3}?q={i}", "x", "y", "z", "v", "i", 1) for i in range(60)] + [(None, None, "x", "y", "z", "v", "i", 1), (7, "https://bad.example/1", "x", "y", "z", "v", "i", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string, items string, best int")
    plain = pages.select("page_id", "url")
    label = F.when(F.col("url").contains("bad"), "block").when(F.col("url").isNotNull(), "allow")
    listed = [("allow", "good.example/1")]
    found = []
    for p in (pages, plain):
        mined = url_filter.mine(p.withColumn("verdict", label), min_support=0.1, min_confidence=0.9, min_lift=1.1)
        found.append(sorted(map(repr, url_filter.judge(p, listed, mined).collect())))
        found.append(sorted(map(repr, url_filter.judge(p, listed, mined, most_rules=0).collect())))
    assert len(found[0]) == 62 and all(f == found[0] for f in found)
    assert sum("verdict='block'" in r for r in found[0]) == 31
