"""A stream of pages and robots files: late files, files that expire, pages that wait in vain."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webloom.streaming.robots import NOT_IN_TIME, robots_verdicts

START = datetime(2024, 1, 1)
PAGES = "page_id long, url string, agent string, seen_at timestamp"
FILES = "origin string, status int, body string, seen_at timestamp"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(spark, folder, batches, **more):
    """The verdicts after each batch of (pages, files); a batch is a file of each stream."""
    found = []
    for kind, schema in (("pages", PAGES), ("files", FILES)):
        os.makedirs(f"{folder}/{kind}")
        for i, batch in enumerate(batches):
            rows = batch[kind == "files"]
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/made/{kind}{i}")

    def feed(i):
        for kind in ("pages", "files"):
            for n, name in enumerate(x for x in os.listdir(f"{folder}/made/{kind}{i}") if x.endswith(".parquet")):
                os.rename(f"{folder}/made/{kind}{i}/{name}", f"{folder}/{kind}/{i}-{n}.parquet")

    def keep(df, _):
        found[-1] += [tuple(r) for r in df.select("page_id", "allowed", "matched_rule", "status", F.coalesce("note", "error").alias("note")).collect()]

    for i in range(len(batches)):  # a new start for each batch: what is known lies in the checkpoint
        feed(i)
        found.append([])
        pages, files = (spark.readStream.schema(s).parquet(f"{folder}/{k}") for k, s in (("pages", PAGES), ("files", FILES)))
        query = robots_verdicts(pages, files, **more).writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)
        found[-1].sort()
    return found


def at(**after):
    return START + timedelta(**after)


def test_late_files_and_expiry(rocks, tmp_path):
    rules = "user-agent: *\ndisallow: /no\n\nuser-agent: bot\ndisallow: /"
    batches = [
        ([(1, "https://a.example/no/1", "x", at()), (2, "https://b.example/2", "x", at()), (3, "https://a.example/yes", "BOT/1", at())], []),
        ([], [("https://a.example", 200, rules, at(minutes=1))]),
        ([(4, "https://a.example/ok", "x", at(minutes=2)), (5, "https://c.example/", "x", at(minutes=2)), (6, "https://d.example/", "x", at(minutes=2)), (7, "no url", "x", at(minutes=2))], [("https://c.example", 404, None, at(minutes=2)), ("https://d.example", 500, None, at(minutes=2))]),
        ([(8, "https://a.example/no/8", "x", at(minutes=3))], [("https://a.example", 200, "user-agent: *\nallow: /", at(minutes=3)), ("https://a.example", 200, "disallow: /", at(minutes=2))]),
        ([(9, "https://a.example/9", "x", at(days=3))], []),
        ([(10, "https://z.example/", "x", at(days=9))], []),
        ([(11, "https://z.example/", "x", at(days=19))], []),
    ]
    found = run(rocks, str(tmp_path), batches)
    assert found[0] == []
    assert found[1] == [(1, False, "Disallow: /no", 200, None), (3, False, "Disallow: /", 200, None)]
    assert found[2] == [(4, True, None, 200, None), (5, True, None, 404, "no robots.txt -- crawl permitted by default"), (6, None, None, 500, "HTTP 500")]
    assert found[3] == [(8, True, "Allow: /", 200, None)]
    # The watermark passes page 2's patience; a's file has expired, so page 9 waits, and goes when its own time has passed.
    late = [r for batch in found[4:] for r in batch]
    assert {(2, True, None, None, NOT_IN_TIME), (9, True, None, None, NOT_IN_TIME), (10, True, None, None, NOT_IN_TIME)} <= set(late) and len(late) == len(set(late))
    assert (2, True, None, None, NOT_IN_TIME) in found[4] and not any(r[0] == 9 for r in found[4])


def test_a_large_origin_in_shares(rocks, tmp_path):
    pages = [(i, f"https://a.example/{i}", None, at()) for i in range(60)]
    found = run(rocks, str(tmp_path), [(pages, []), ([], [("https://a.example", 200, "user-agent: *\ndisallow: /1", at(minutes=1))])], shares=4)
    assert found[0] == [] and [r[0] for r in found[1]] == list(range(60))
    assert {r[0] for r in found[1] if not r[1]} == {i for i in range(60) if str(i).startswith("1")}
