"""Near-duplicate and leak operators against brute force."""

import random

import numpy as np
import pytest
from brute import Sets, distance, substring_distance
from helpers import awkward, empty, text
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import decontaminate, edits, groups, jaccard_join, line_dedup, neighbours
from webloom.llm.words import _piece, shingles, word_hashes


def changed(r, s, n, letters="abcxyz "):
    s = list(s)
    for _ in range(n):
        k, o = r.randrange(len(s) + 1), r.random()
        if o < 0.4 or k == len(s):
            s.insert(k, r.choice(letters))
        elif o < 0.7:
            del s[k]
        else:
            s[k] = r.choice(letters)
    return "".join(s)


def test_edit_distances():
    r = random.Random(2)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
        b = changed(r, a, r.randint(0, 4), "abc") if r.random() < 0.5 else "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
        d = distance(a, b)
        for most in range(4):
            assert edits.within(a, b, most) == (d if d <= most else None)
        if a:
            best = substring_distance(a, b)
            assert edits.Pattern(a).best(b, 3) == (best if best[0] <= 3 else None)


@pytest.mark.parametrize("in_one_task", [0, 1000])
def test_components(spark, in_one_task):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    found = {x.node: x.label for x in groups.components(spark.createDataFrame(edges, "a long, b long"), in_one_task).collect()}
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    assert found == {x: sets.top(x) for x in {n for e in edges for n in e} if sets.top(x) != x}


def shingle_words(t):
    w = [x for x in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()]
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute_components(rows):
    sets, joined = [shingle_words(t) for _, t in rows], Sets()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                joined.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[joined.top(i)] = min(d, least.get(joined.top(i), d))
    return [(d, len(s), least.get(joined.top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_jaccard_join(spark):
    r = random.Random(3)
    rows, n = [], 100
    for seed, length in [(10, 5), (11, 9), (12, 13), (13, 20), (14, 35), (15, 60), (16, 150), (17, 400)]:
        base = text(seed, length).split()
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, max(1, length // 40))):
                k, o = r.randrange(len(w)), r.random()
                w[k : k + 1] = [] if o < 0.3 else ["new%d" % r.randint(0, 3)] if o < 0.7 else [w[k], "more"]
            rows.append((n, " ".join(w).upper() if r.random() < 0.2 else "\n".join(w)))
            n += 1
    docs = awkward(spark, rows)
    given = [(x.doc_id, x.text) for x in docs.collect()]
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_components(given), key=str)
    linked = {c for _, n, c in got if n}
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.where("text rlike '[a-zA-Z0-9]'").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in linked if i is not None)
    assert jaccard_join.join(empty(spark)).count() == 0 and jaccard_join.representatives(empty(spark)).count() == 0


def test_jaccard_of_other_words_and_percent(spark):
    """Against brute force, in light sets and heavy ones."""
    r, rows = random.Random(4), []
    for seed, length in [(10, 8), (11, 14), (12, 25), (13, 60), (14, 200)]:
        base = text(seed, length).split()
        for i in range(12):
            w = list(base)
            for _ in range(r.randint(0, max(1, length // 40))):
                w[r.randrange(len(w))] = f"new{r.randint(0, 3)}"
            rows.append((100 + len(rows), " ".join(w + [f"more{i}x{j}" for j in range(r.randint(0, length // 3))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for words, percent in ((5, 80), (4, 85)):
        sets, joined = [], Sets()
        for i, (_, t) in enumerate(rows):
            w = t.split()
            a = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= percent * len(a | b):
                    joined.join(i, j)
            sets.append(a)
        found[words] = {d: rows[joined.top(i)][0] for i, (d, _) in enumerate(rows)}
        assert {x.doc_id: x.component_id for x in jaccard_join.join(docs, words, percent).collect()} == found[words]
        assert {x.doc_id for x in jaccard_join.representatives(docs, words, percent).collect()} == set(found[words].values())
    assert found[5] != found[4]


def test_pipeline_stage_links_from_four_fifths_of_five_words_on(spark):
    base = text(70, 104)
    docs = spark.createDataFrame([(1, base), (2, f"{base} {text(71, 22)}"), (3, f"{base} {text(72, 28)}")], "doc_id long, text string")
    assert [x.doc_id for x in jaccard_join.join(docs).select("component_id").distinct().withColumnRenamed("component_id", "doc_id").orderBy("doc_id").collect()] == [1, 2, 3]
    assert sorted(x.doc_id for x in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [1, 3]


def test_light_sets_pay_where_they_are_cheap():
    assert jaccard_join.boundary({}) == 0
    light = jaccard_join.boundary({n: 100 for n in range(1, 49)})
    assert 3 <= light < jaccard_join.MOST_LIGHT
    assert jaccard_join.least_overlap(100, 100) == 92 and jaccard_join.posted(100) == 16


def test_hashes_of_long_texts_are_those_of_short_ones():
    data = (text(5, 200_000) + "  \x0b ").encode()
    assert len(data) > 1 << 20
    words = word_hashes(data)
    assert len(words) == 200_000 and (words[:1000] == word_hashes(b" ".join(data.split()[:1000]))).all()
    assert len(shingles(words[:3], 4)) == 1 and len(shingles(words[:0], 4)) == 0
    long = bytes(random.Random(1).choices(b"abcdef", k=3_500_000))
    swapped = long[65536:131072] + long[:65536] + long[131072:]
    for data in (b"x " + long + b" y z", long, b"x " * 600_000 + long + b" " + b"y " * 600_000):
        assert (word_hashes(data) == np.concatenate([_piece(w) for w in data.split()[:3]] + [_piece(w) for w in data.split()[3:][-3:]])).all() if len(data.split()) < 6 else len(word_hashes(data)) == 1_200_001
    assert word_hashes(long) != word_hashes(swapped) and word_hashes(long)[0] == _piece(long)[0]


def brute_dropped(rows, places):
    lines = [(d, t, i, line.strip().lower()) for d, t in rows for i, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[3]) >= line_dedup.MIN_CHARS]
    distinct, sets = sorted({x[3] for x in lines}), Sets()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if abs(len(a) - len(b)) <= line_dedup.EDITS and distance(a, b) <= line_dedup.EDITS:
                sets.join(a, b)
    order = lambda x: (x[0] is None, x[0] or 0, places[x[1]], x[2])
    first = {}
    for x in lines:
        first[sets.top(x[3])] = min(first.get(sets.top(x[3]), order(x)), order(x))
    out = {}
    for x in lines:
        if order(x) != first[sets.top(x[3])]:
            out.setdefault((x[0], places[x[1]]), set()).add(x[2])
    return {k: sorted(v) for k, v in out.items()}


def test_line_dedup(spark):
    r = random.Random(5)
    base = [text(20 + i, r.randint(6, 9)) for i in range(20)]
    rows = [(100 + i, "\n".join(changed(r, r.choice(base), r.randint(0, 4)) if r.random() < 0.8 else r.choice(["", "short"]) for _ in range(r.randint(0, 6)))) for i in range(60)]
    rows += [(200, rows[3][1]), (103, rows[3][1]), (None, rows[5][1])]
    docs = awkward(spark, rows)
    given = [(x.doc_id, x.text) for x in docs.collect()]
    places = {x.text: x.p for x in docs.select("text", line_dedup.place_of("text").alias("p")).collect()}
    got = {(x.doc_id, x.place): x.dropped for x in line_dedup.dropped_lines(docs).collect()}
    wanted = brute_dropped(given, places)
    assert len(wanted) > 20 and got == wanted
    docs = docs.withColumnsRenamed({"part": "dropped", "n": "of", "key": "at"})
    out = line_dedup.deduped(docs)
    assert out.columns == [*docs.columns, line_dedup.DROPPED] and out.count() == docs.count()
    before = {(x.doc_id, x.text) for x in docs.collect()}
    for x in out.collect():
        gone = wanted.get((x.doc_id, places.get(x.text))) if x[line_dedup.DROPPED] is None else x[line_dedup.DROPPED]
        assert ((x.doc_id, x.text) in before) == (x[line_dedup.DROPPED] is None) and (gone is None) == (x[line_dedup.DROPPED] is None)
    assert line_dedup.digests(empty(spark)).count() == 0
    assert line_dedup.digests(awkward(spark)).count() == awkward(spark).count()


def test_line_lookups_cover_all_places():
    """Every string within the edits shares a segment with one of the looked-up substrings."""
    r = random.Random(6)
    for _ in range(400):
        a = "".join(r.choice("ab") for _ in range(r.randint(line_dedup.MIN_CHARS, 50)))
        b = changed(r, a, line_dedup.EDITS, "ab")
        if len(b) < line_dedup.MIN_CHARS:
            continue
        _, parities, keys = line_dedup.line_keys([a, b])
        assert bin(int(parities[0] ^ parities[1])).count("1") <= line_dedup.FLIPS * line_dedup.EDITS
        own = line_dedup.EDITS + 1
        assert set(keys[0][:own]) & set(keys[1]) or set(keys[1][:own]) & set(keys[0])


def test_neighbour_keys_hold_all_links():
    """Strings within the edits meet under a key, at every level; where no rest decides, only such strings do."""
    r = random.Random(9)

    def meet(a, b, edits, context=0):
        sides = []
        for x in (a, b):
            sides.append({})
            for k, lookup, rest in zip(*neighbours.keys_of(x, context, edits), strict=True):
                sides[-1].setdefault(k, []).append((lookup, rest))
        for k in sides[0].keys() & sides[1].keys():
            for u, x in sides[0][k]:
                for v, y in sides[1][k]:
                    if not (u and v) and (x is None or meet(np.frombuffer(x, dtype=neighbours.LETTER), np.frombuffer(y, dtype=neighbours.LETTER), edits, k)):
                        return True
        return False

    near = 0
    for _ in range(600):
        a = "".join(r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.choice([3, 8, 15, 22, 23, 24, 25, 26, 30, 45, 70, 160])))
        b = changed(r, a, r.randint(0, 5), "ab")
        pair = neighbours.letters_of(a), neighbours.letters_of(b)
        near += edits.within(a, b, 2) is not None
        assert meet(*pair, 2) == (edits.within(a, b, 2) is not None)
        if len(a) <= 20 and len(b) <= 20:
            assert meet(*pair, 1) == (edits.within(a, b, 1) is not None)
    assert near > 200


def test_crowded_lines_equal_brute_force(spark):
    """Lists of more than two lines go to the narrower keys."""
    r = random.Random(10)
    base = ["".join(r.choice("abcdef ") for _ in range(n)) for n in (14, 24, 40, 90)]
    rows = [(i, "\n".join(changed(r, r.choice(base), r.randint(0, 5)) for _ in range(4))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute_short(rows)
    for crowd in (0, 2):
        assert {x.doc_id: x.dropped for x in line_dedup.dropped_lines(docs, crowd).collect()} == wanted


def test_many_alike_lines_cost_their_number(spark, monkeypatch):
    """Two thousand lines that share most of their text, few of them linked: candidate pairs follow the lines, not their square."""
    r = random.Random(11)
    made = lambda: f"posted by {''.join(r.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(10))} in the forum of all members, reply"
    lines = [made() for _ in range(2000)]
    lines += [x[:15] + "!" + x[16:] for x in lines[:20]]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    seen, verify = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda d, s, pairs: seen.append(pairs.count()) or verify(d, s, pairs))
    assert {x.doc_id: x.dropped for x in line_dedup.dropped_lines(docs).collect()} == {2000 + i: [0] for i in range(20)}
    assert sum(seen) < 3 * len(lines)


def test_alike_sets_equal_brute_force(spark):
    """Documents that share most of a template, with more or less of their own."""
    r = random.Random(12)
    template = text(90, 150).split()
    rows = []
    for i in range(80):
        w = list(template)
        for _ in range(r.choice([0, 1, 3, 5, 8])):
            w[r.randrange(len(w))] = f"own{i}"
        rows.append((i, " ".join(w + [f"tail{r.randint(0, 9)}x{j}" for j in range(r.randint(0, 12))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(docs).collect()) == sorted(brute_components(rows))


def test_short_lines(spark):
    """Repeats of any length go; edits follow the length."""
    rows = [(1, "a\nRights reserved.\n \nabcdefghi"), (2, "a\n rights reserved. \n\nabcdefghx"), (3, "b\nrights reserve.\nunder the mit licenses now"), (4, "under a mit licence now")]
    rows += [(5, "under the mit licence now\n19 characters here."), (6, "20 characters here..\n20 characters here!."), (7, "20 character's here..\n19 characters here!.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.dropped for x in line_dedup.dropped_lines(docs).collect()}
    assert got == brute_short(rows) and got[2] == [0, 1] and got[3] == [1]
    r = random.Random(8)
    base = ["".join(r.choice("abcdef ") for _ in range(n)) for n in range(1, 32) for _ in range(2)]
    rows = [(i, "\n".join(changed(r, r.choice(base), r.randint(0, 2)) for _ in range(4))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.dropped for x in line_dedup.dropped_lines(docs).collect()} == brute_short(rows)


def brute_short(rows):
    lines = [(d, i, x) for d, t in rows for i, line in enumerate(t.split("\n")) if (x := line.strip().lower())]
    distinct, sets, first, out = sorted({x for _, _, x in lines}), Sets(), {}, {}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if distance(a, b) <= min(2, min(len(a), len(b)) // 10):
                sets.join(a, b)
    for d, i, x in lines:
        if first.setdefault(sets.top(x), (d, i)) != (d, i):
            out.setdefault(d, []).append(i)
    return out


def test_leaks(spark):
    r = random.Random(7)
    items = [(i, text(40 + i, r.randint(5, 30))) for i in range(12)] + [(50, "too short"), (51, None), (52, ""), (53, text(40, 8))]
    rows = []
    for i in range(60):
        item = r.choice(items[:12])[1]
        k = int(decontaminate.RATE * len(item))
        inside = changed(r, item, r.choice([0, 1, k, k + 1, 3 * k + 3]))
        rows.append((100 + i, f"{text(200 + i, 20)}\n {inside.upper() if i % 5 == 0 else inside}\t{text(300 + i, 10)}"))
    docs = awkward(spark, rows).where("coalesce(length(text), 0) < 10000")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = set()
    for x in docs.collect():
        t = decontaminate.normalised(x.text)
        for i, item in items:
            item = decontaminate.normalised(item)
            if edits := int(decontaminate.RATE * len(item)):
                d, _ = substring_distance(item, t)
                if d <= edits:
                    wanted.add((x.doc_id, i, d))
    got = decontaminate.leaks(docs, benchmark)
    assert {(x.doc_id, x.item_id, x.distance) for x in got.collect()} == wanted and len(wanted) > 20
    clean = decontaminate.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns
    assert clean.count() == docs.count() - len({d for d, _, _ in wanted})
    assert decontaminate.leaks(empty(spark), benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, benchmark.limit(0)).count() == docs.count()


def test_leaks_of_long_texts(spark):
    """Items at both ends and in the middle of very long texts, with edits; and an item that is itself long."""
    items = [(i, text(400 + i, 25)) for i in range(4)] + [(9, text(500, 4000))]
    r, long = random.Random(8), text(600, 60_000).split()
    edited = lambda i: changed(r, items[i][1], int(decontaminate.RATE * len(items[i][1])), "abc")
    texts = [" ".join(long), " ".join([edited(0), *long, edited(1), *long, edited(2)]), " ".join([*long[:500], changed(r, items[4][1], 200, "xyz"), *long[:500]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 9)}


def test_short_items(spark):
    """Items of 12 characters or fewer match without edits, where no word is cut."""
    items = [(1, "What is  2+2?"), (2, "Cat"), (3, " "), (4, None), (5, "cat"), (6, "(x)")]
    texts = ["so what IS\n2+2? four", "what is 2+3?", "concatenate", "the cat, the cat", "cats", "cat", "concat cat", "f(x)", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.distance, x.end_at) for x in decontaminate.leaks(docs, benchmark).collect()}
    assert got == {(0, 1, 0, 15), (7, 6, 0, 4)} | {(d, i, 0, e) for d, e in ((3, 7), (5, 3), (6, 10)) for i in (2, 5)}
    assert {x.doc_id for x in decontaminate.without_leaks(docs, benchmark).collect()} == {1, 2, 4, 8}


@pytest.mark.parametrize("seed", range(4))
def test_edits_follow_the_length(seed):
    """Items of 8 to 40 characters: the same rate for all, and whole words only where it gives no edit."""
    r = random.Random(seed)
    for _ in range(60):
        item = "".join(r.choice("abc de") for _ in range(r.randint(8, 40))).strip()
        item = decontaminate.normalised(item)
        edits = int(decontaminate.RATE * len(item))
        inside = changed(r, item, r.randint(0, edits + 1), "abcx ")
        whole = decontaminate.normalised(f"{'xyz ' * r.randint(0, 3)}{r.choice(['', 'y'])}{inside}{r.choice(['', 'z'])} {'zyx ' * r.randint(0, 3)}")
        found = [(d, end) for _, d, end in decontaminate.Matcher([(1, item)], decontaminate.RATE).matches(whole)]
        if edits:
            d, end = substring_distance(item, whole)
            assert found == ([(d, end)] if d <= edits else []), (item, whole)
        else:
            places = [m for m in range(len(whole)) if whole.startswith(item, m) and decontaminate._whole_words(whole, m, m + len(item))]
            assert [d for d, _ in found] == [0] * bool(places), (item, whole)


def test_one_edit_in_a_short_item():
    matcher = decontaminate.Matcher([(1, "the quick brown fox")], decontaminate.RATE)
    assert matcher.matches("so the quick brown fix went") == [(1, 1, 22)] and matcher.matches("so the quick brawn fix went") == []


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    items = [(i, text(40 + i, 12)) for i in range(9)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontaminate.blocks_of(benchmark))) > 2
    got = decontaminate.leaks(docs, benchmark)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(i, i) for i, _ in items}
    more = docs.unionByName(spark.createDataFrame([(77, None), (78, text(99, 12))], docs.schema))
    assert {x.doc_id for x in decontaminate.without_leaks(more, benchmark).collect()} == {77, 78}
