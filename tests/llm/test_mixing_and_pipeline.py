"""Source mix against brute force, and the pipeline stage by stage."""

import random
from collections import defaultdict
from pathlib import Path

import brute
import pytest
from helpers import awkward, empty, text
from oracle import SMALL, assert_same, connection

import corpus_pipeline
from webloom.llm import decontaminate, jaccard_join, line_dedup, mixing, quality, queries
from webloom.tables import table


def test_apportionment_is_by_highest_quotient():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 6)
        votes = [r.choice([0, r.randint(1, 50), r.random() * 100]) for _ in range(n)]
        caps = [r.randint(0, 40) for _ in range(n)]
        seats = r.randint(0, 60)
        won = [0] * n
        for _ in range(seats):
            open_ = [i for i in range(n) if votes[i] > 0 and won[i] < caps[i]]
            if not open_:
                break
            won[max(open_, key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        got = mixing.sainte_lague(seats, votes, caps)
        assert sum(got) == sum(won)
        assert sorted(v / (2 * g + 1) for v, g in zip(votes, got, strict=True)) == pytest.approx(sorted(v / (2 * w + 1) for v, w in zip(votes, won, strict=True)))


def test_sharing_out():
    assert mixing.share_out(150, [3, 1, 2], [200, 200, 200]) == [75, 25, 50]
    assert mixing.share_out(150, [3, 1, 2], [20, 200, 200]) == pytest.approx([20, 130 / 3, 260 / 3])
    assert mixing.share_out(150, [3, 1, 2], [20, 30, 60]) == [20, 30, 60]


def test_mix(spark):
    r = random.Random(2)
    sizes = {"a": 400, "b": 40, "ä": 15, None: 90, "z": 3}
    rows = [(i, text(i, r.randint(0, 60)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(5, rows[5][1], "a"), (None, "one two", "b"), (9000, None, "only null")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, size long, target int")
    one = mixing.mix(docs, shard_tokens=500)
    got = one.collect()
    assert len(got) == len(rows) and mixing.mix(docs, shard_tokens=500).exceptAll(one).count() == 0
    total, taken, target, size = sum(x.size for x in got), defaultdict(int), {}, {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
        target[x.source], size[x.source] = x.target, x.source_size
    assert sum(target.values()) == pytest.approx(1.5 * total)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    free = [s for s in names if target[s] < 2 * size[s] - 1e-6]
    assert len({round(target[s] / weights[s], 6) for s in free}) <= 1
    for s in names:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= max(3, 0.02 * target[s])


def test_taken_words_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(i, text(i, r.choice([0, 1, 5, 30, 200])), s) for i, s in enumerate(s for s, n in {"a": 90, "b": 25, None: 40}.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x.taken for x in mixing.mix(docs, seed=5, block_tokens=16, shard_tokens=900).collect()}
    assert got == brute.taken_words(docs, 5, 16, 900)


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark)
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(docs.where("text is null")).selectExpr("sum(taken)").first()[0] == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL).toPandas(), connection().sql(queries.ORACLES[name]).df())


def test_all_ten_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        had, has = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}
        assert set(has) <= set(had)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "quality_classifier":
            labels = table(spark, SMALL, "labels").selectExpr("doc_id", "quality as label")
            assert set(has) == {r.doc_id for r in quality.classify(before, labels).where("predicted = 1").collect()}
        elif name == "line_dedup":
            gone = {r.doc_id: r[line_dedup.DROPPED] for r in line_dedup.deduped(before).collect()}
            for d, r in had.items():
                left = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in set(gone[d] or []))
                assert (has[d].text, has[d].n_chars) == (left, len(left)) if gone[d] is None or left.strip() else d not in has
        elif name == "ngram_jaccard_join":
            rows = jaccard_join.join(before).collect()
            assert set(has) == {r.component_id for r in rows}
        elif name == "benchmark_decontamination":
            leaks = decontaminate.leaks(before, table(spark, SMALL, "benchmark")).collect()
            assert set(has) == set(had) - {r.doc_id for r in leaks}
    assert set(has) == set(had) and sum(r.taken for r in has.values()) == pytest.approx(1.5 * sum(r.size for r in has.values()), rel=0.02)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages against plain versions, over all rows of a small corpus with copies, leaks, repeated lines and junk."""
    r, rows = random.Random(21), []
    items = [(i, text(900 + i, 12)) for i in range(4)]
    line = lambda k: " ".join(r.choice(["the", "of", "and", text(k, 1)]) for _ in range(r.randint(4, 12)))
    shared = [line(700 + i) + "." for i in range(5)]
    for i in range(90):
        good = "\n".join([line(i * 10 + k).capitalize() + "." for k in range(r.randint(2, 5))] + r.sample(shared, r.choice([0, 1, 2])))
        if i % 9 in (4, 5):  # one long line, and the same with another word
            good = " ".join(w if k != 3 or i % 9 == 4 else "replacement" for k, w in enumerate(text(500 + i // 9, 70).split())) + "."
        if i % 11 == 7:
            good += "\n" + items[i % 4][1].replace("a", "e", 1).upper()
        rows.append((i, good if i % 3 else "".join(r.choice("#$%|<>~^@ 0123456789") for _ in range(r.randint(5, 200)))))
    rows += [(90, ""), (91, shared[0]), (92, rows[1][1])]
    frame = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in rows]
    spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    scores = brute.quality_scores(spark, docs, table(spark, str(tmp_path), "labels"))
    assert min(abs(s - quality.THRESHOLD) for s in scores.values()) > 1e-3
    kept = [(i, t) for i, t in rows if scores[i] >= quality.THRESHOLD]
    left = [(i, t) for (i, before), (_, t) in zip(kept, brute.kept_lines(kept), strict=True) if t == before or t.strip()]
    ids = set(brute.one_of_each(left, 5, 80))
    clean = [(i, t) for i, t in left if i in ids and not any(brute.holds(t, item) for _, item in items)]
    assert len(rows) > len(kept) > len(left) > len(ids) > len(clean) > 20 and kept != left
    final = spark.createDataFrame([(i, t, "abc"[i % 3]) for i, t in clean], "doc_id long, text string, source string")
    wanted = brute.taken_words(final)
    from webloom import cut

    cut.clear_written(spark)
    other = cut.written(spark.range(3), "other")
    folder = Path(cut._written[-1].rpartition("/")[0].removeprefix("file://"))
    before = set(folder.iterdir())  # other runs may have left theirs
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id: x.taken for x in found.collect()} == wanted
    # Of all that the stages wrote the last one's output is left, and what others wrote before.
    left = list(cut._written)
    assert len(left) == 2 and other.count() == 3
    assert cut.clear_written(spark) == 2 and not [p for p in set(folder.iterdir()) - before if any(p.name.startswith(n) for n, _ in corpus_pipeline.STAGES)]


def test_pipeline_on_no_documents(spark, tmp_path):
    docs = table(spark, SMALL, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0, name


def test_pipeline_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark, [(300, None), (301, "line " * 30), (302, "line " * 30), (303, "\n" * 5)]).withColumnsRenamed({"part": "of", "n": "at"})
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert name == "source_mix" or docs.columns == columns
