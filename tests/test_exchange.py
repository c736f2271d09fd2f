"""Requests as a data source: lanes that hold up no other, replayed pages, writers that are lost or copied."""

import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.cut import clear_written, folder
from webloom.sources import exchange as E
from webloom.sources import http as S
from webloom.sources import lanes

REQUEST = "request_id long, request struct<url:string,method:string>"


class Timed(S.Captured):
    """Hosts that begin with slow take a second."""

    def send(self, method, url, address, headers, body, timeout_s, max_bytes):
        time.sleep(1.0 if url.netloc.startswith("slow") else 0)
        return S.Raw(200, headers={"content-type": "text/plain"}, body=str(time.time()).encode())


def jobs(urls):
    return iter([lanes.Job(i, {"url": u}, u.split("/")[2]) for i, u in enumerate(urls)])


def test_a_slow_host_holds_up_no_other():
    """The case of a full pool: many requests to one slow host come before those to hosts that answer at once."""
    urls = [f"https://slow.example/{i}" for i in range(32)] + [f"https://h{i}.example/" for i in range(16)]
    began, done = time.monotonic(), {}
    for job in lanes.answered(jobs(urls), S.tries(Timed([]))):
        done[job.id] = time.monotonic() - began
        if all(i in done for i in range(32, 48)):
            break
    assert max(done[i] for i in range(32, 48)) < 0.5


def test_retries_wait_in_a_queue():
    """A host that asks for a pause takes no thread meanwhile; its request is tried again when it is due."""

    class Busy(S.Captured):
        def send(self, method, url, address, headers, body, timeout_s, max_bytes):
            return S.Raw(503, headers={"Retry-After": "1"}) if url.netloc.startswith("busy") else S.Raw(200)

    rows = [lanes.Job(i, {"url": f"https://busy{i}.example/", "retries": 1}, f"busy{i}") for i in range(40)] + [lanes.Job(100 + i, {"url": f"https://h{i}.example/"}, f"h{i}") for i in range(40)]
    began, order = time.monotonic(), []
    for job in lanes.answered(iter(rows), S.tries(Busy([])), at_once=2):
        order.append((job.id, job.attempt, time.monotonic() - began))
    assert sorted(i for i, _, _ in order[:40]) == list(range(100, 140)) and order[39][2] < 0.8
    assert all(attempt == 1 and 1 <= t < 2 for _, attempt, t in order[40:])


def test_jobs_are_read_as_threads_are_free():
    read = []

    def source():
        for i in range(100):
            read.append(i)
            yield lanes.Job(i, {"url": f"https://h{i}.example/"}, f"h{i}")

    found = lanes.answered(source(), S.tries(S.Captured([])), at_once=4)
    next(found)
    assert len(read) <= 12
    assert len(list(found)) == 99
    one_lane = iter([lanes.Job(i, {"url": "https://slow.example/"}, "slow") for i in range(50)])
    taken = lanes.answered(one_lane, S.tries(S.Captured([])), window=5)
    next(taken)
    assert next(one_lane).id <= 10


def test_errors_of_a_thread_are_the_tasks():
    class Broken(S.Captured):
        def send(self, *_):
            raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        list(lanes.answered(jobs(["https://a.example/"]), S.tries(Broken([]))))


def test_lanes_of_a_host(spark):
    rows = spark.range(400).select(F.col("id").alias("request_id"), F.struct(F.concat(F.lit("https://Host"), F.col("id") % 2, F.lit(".example/"), "id").alias("url")).alias("request"))
    placed = lanes.dealt(rows, 6).select("lane", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(placed) == len({r.lane for r in placed}) == 2 * lanes.PER_HOST and all(r.lane.startswith("host") for r in placed)


def test_one_slow_host_of_a_table(spark):
    """One task, a third of its requests to a slow host: all others end before the slow ones do."""
    rows = [(i, {"url": f"https://{'slow' if i % 3 == 0 else f'h{i}'}.example/{i}", "method": "GET"}) for i in range(36)]
    began = time.time()
    got = S.fetch(spark.createDataFrame(rows, REQUEST).coalesce(1), Timed([]), tasks=1).collect()
    ended = {r.request_id: float(r.response.body_text) for r in got}
    others = [t for i, t in ended.items() if i % 3]
    assert max(others) - min(others) < 0.9 and max(ended.values()) - min(others) > 1.5 and time.time() - began < 30


def test_replay_through_the_reader(spark):
    E.register(spark)
    responses = spark.createDataFrame(
        [("GET", f"https://h{i % 3}.example/{i}", 0, 200, "OK", {"Content-Type": "text/plain"}, bytearray(f"body {i}".encode())) for i in range(30)],
        "method string, url string, attempt int, status int, status_text string, headers map<string,string>, body binary",
    )
    transport = E.stage_captured(responses, folder(spark, "captured"), buckets=4)
    asked = spark.createDataFrame([(f"r{i}", {"url": f"https://H{i % 3}.example/{i}", "method": "GET" if i < 31 else "POST"}) for i in range(32)], REQUEST.replace("long", "string"))
    path = folder(spark, "requests")
    E.stage_requests(asked, path, 5)
    read = spark.read.format("webloom_http").options(**E.http_options(path, transport, id_type="string")).load()
    got = {r.request_id: r.response for r in read.collect()}
    assert len(got) == 32 and all(got[f"r{i}"].body_text == f"body {i}" for i in range(30))
    assert got["r30"].error.startswith("no response captured") and got["r31"].error == "POST is not idempotent: use send"
    assert read.rdd.getNumPartitions() <= 5
    empty = folder(spark, "requests")
    E.stage_requests(asked.limit(0), empty)
    assert spark.read.format("webloom_http").options(**E.http_options(empty, transport, id_type="string")).load().count() == 0
    clear_written(spark)


# Writers


def batch(n, lane=True):
    request = [{"url": f"https://a{i}.example/{i}", "method": "POST"} for i in range(n)]
    return pa.RecordBatch.from_pydict({"request_id": list(range(n)), "request": request, "lane": [f"a{i}" for i in range(n)]})


def writer(tmp_path, transport, lease=1.0):
    (tmp_path / "responses").mkdir(exist_ok=True)
    schema = T.StructType([T.StructField("request_id", T.LongType())])
    return E.HttpWriter(E.http_options(str(tmp_path), transport, lease), schema)


def shown(tmp_path):
    import pyarrow.parquet as pq

    rows = [r for f in sorted((tmp_path / "responses").glob("part-*.parquet")) for r in pq.read_table(f).to_pylist()]
    return {r["request_id"]: r["response"] for r in rows} if len({r["request_id"] for r in rows}) == len(rows) else None


class Counted:
    """Writes down what it sends; the class attribute survives pickling within a process."""

    sent: list = []
    seconds = 0.0
    dies_at = None

    def resolve(self, host):
        return ["93.184.216.34"]

    def send(self, method, url, address, headers, body, timeout_s, max_bytes):
        time.sleep(Counted.seconds)
        if Counted.dies_at is not None and int(url.pathname[1:]) >= Counted.dies_at:
            raise RuntimeError("lost")
        Counted.sent.append(url.pathname)
        return S.Raw(201)


@pytest.fixture(autouse=True)
def fresh(monkeypatch):
    monkeypatch.setattr(Counted, "sent", [])
    monkeypatch.setattr(Counted, "seconds", 0.0)
    monkeypatch.setattr(Counted, "dies_at", None)
    monkeypatch.setattr(E, "BEAT_S", 0.1)


def test_responses_show_when_all_tasks_have_ended(tmp_path):
    w = writer(tmp_path, Counted())
    said = [w.task(iter([batch(5)]), 0, 0), w.task(iter([]), 1, 0)]
    assert shown(tmp_path) == {}
    w.commit([*said, None])
    assert {r["status"] for r in shown(tmp_path).values()} == {201} and len(shown(tmp_path)) == 5
    assert {p.name[:5] for p in (tmp_path / "responses").iterdir()} == {"part-"}


def test_a_speculative_copy_waits_for_the_first(tmp_path, monkeypatch):
    """The copy sends nothing, ends with what the first has said, and no row says UNKNOWN."""
    monkeypatch.setattr(Counted, "seconds", 1.5)
    w, said = writer(tmp_path, Counted(), lease=0.8), {}
    first = threading.Thread(target=lambda: said.update(first=w.task(iter([batch(20)]), 0, 0)))
    first.start()
    said["copy"] = w.task(iter([batch(20)]), 0, 1)
    first.join()
    assert said["copy"].files == said["first"].files and len(Counted.sent) == 20
    w.commit([said["copy"]])
    assert {r["status"] for r in shown(tmp_path).values()} == {201}


def test_a_lost_first_attempt(tmp_path, monkeypatch):
    """A second attempt keeps what the first had stored and says UNKNOWN of the rest; a third does no more."""
    monkeypatch.setattr(Counted, "dies_at", 70)
    w = writer(tmp_path, Counted(), lease=0.5)
    with pytest.raises(RuntimeError):
        w.task(iter([batch(100)]), 0, 0)
    n = len(Counted.sent)
    second = w.task(iter([batch(100)]), 0, 1)
    third = w.task(iter([batch(100)]), 0, 2)
    assert len(Counted.sent) == n and sorted(third.files) == sorted(second.files)
    w.commit([second])
    found = shown(tmp_path)
    assert len(found) == 100 and 64 <= sum(r["status"] == 201 for r in found.values()) <= n
    assert {r["error"] for r in found.values() if r["status"] == 0} == {E.UNKNOWN} and found[99]["url"] == "https://a99.example/99"


def test_an_aborted_job_shows_what_it_got(tmp_path, monkeypatch):
    monkeypatch.setattr(Counted, "dies_at", 70)
    w = writer(tmp_path, Counted())
    with pytest.raises(RuntimeError):
        w.task(iter([batch(100)]), 0, 0)
    w.abort([None])
    assert len(shown(tmp_path)) >= 64 and all(r["status"] == 201 for r in shown(tmp_path).values())


def test_overwriting_a_log_is_refused(spark, tmp_path):
    E.register(spark)
    rows = spark.createDataFrame([(1, {"url": "https://a.example/", "method": "POST"})], REQUEST)
    with pytest.raises(Exception, match="append to the log"):
        rows.write.format("webloom_http").options(**E.http_options(str(tmp_path))).mode("overwrite").save()


# Cost


def test_a_lanes_jobs_take_turns_in_a_thread():
    """Requests that are answered at once don't each wait for a thread, and a slow lane gives its thread back after one."""

    def attempt(job):
        time.sleep(0.05 if job.lane == "slow" else 0)

    rows = [lanes.Job(i, {}, "fast") for i in range(2000)] + [lanes.Job(2000 + i, {}, "slow") for i in range(5)]
    under_way = []

    class Counting(lanes.ThreadPoolExecutor):
        def submit(self, f, jobs):
            under_way.append(len(jobs))
            return super().submit(f, jobs)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(lanes, "ThreadPoolExecutor", Counting)
        found = [j.id for j in lanes.answered(iter(rows), attempt)]
    assert sorted(found) == list(range(2005)) and [i for i in found if i < 2000] == list(range(2000)) and [i for i in found if i >= 2000] == list(range(2000, 2005))
    assert max(under_way) == lanes.IN_TURN and len(under_way) < 500


def test_what_was_answered_before_an_error_is_given():
    def attempt(job):
        if job.id == 100:
            raise RuntimeError("lost")

    got = []
    with pytest.raises(RuntimeError):
        for jobs in lanes.batches(lanes.answered(iter([lanes.Job(i, {}, "a") for i in range(200)]), attempt)):
            got += [j.id for j in jobs]
    assert got == list(range(100))


def test_lanes_of_a_host_are_different_tasks(spark):
    rows = spark.range(4000).select(F.col("id").alias("request_id"), F.struct(F.concat(F.lit("https://h"), F.col("id") % 9, F.lit(".example/"), "id").alias("url")).alias("request"))
    placed = lanes.dealt(rows, 9).select("lane", F.spark_partition_id().alias("task")).distinct().collect()
    hosts = {}
    for r in placed:
        hosts.setdefault(r.lane.partition("#")[0], []).append(r.task)
    assert len(hosts) == 9 and all(len(t) == len(set(t)) == lanes.PER_HOST for t in hosts.values())


def test_a_lookup_reads_few_rows(spark, monkeypatch):
    """One host of many responses: buckets follow the number of rows, and a lookup reads one row group of one of them."""
    n = 5000
    made = F.struct(F.lit("GET").alias("method"), F.concat(F.lit("https://h.example/"), "id").alias("url"), F.lit(0).alias("attempt"), F.lit(200).alias("status"), F.lit("").alias("status_text"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"), F.col("id").cast("string").cast("binary").alias("body"))
    transport = E.stage_captured(spark.range(n).select(made.alias("r")).select("r.*"), folder(spark, "captured"))
    read = []

    class Seen(E.pq.ParquetFile):
        def read_row_groups(self, groups, **options):
            read.append(sum(self.metadata.row_group(i).num_rows for i in groups))
            return super().read_row_groups(groups, **options)

    monkeypatch.setattr(E.pq, "ParquetFile", Seen)
    for i in range(0, n, 500):
        (row,) = transport.captured(f"https://h.example/{i}")
        assert row["body"] == str(i).encode()
    assert transport.captured("https://h.example/none") == [] and transport.buckets == 6 and max(read) <= E.GROUP_ROWS
    clear_written(spark)


def test_pieces_become_tables(tmp_path):
    """Responses are stored by 64 as they come, and shown by thousands; no piece stays."""
    w = writer(tmp_path, Counted())
    w.commit([w.task(iter([batch(5000)]), 0, 0)])
    assert len(shown(tmp_path)) == 5000 and len(list((tmp_path / "responses").iterdir())) == 2


def test_pieces_of_a_lost_attempt(tmp_path, monkeypatch):
    """A loss between storing a table and dropping its pieces gives no row twice."""
    monkeypatch.setattr(Counted, "dies_at", 4500)
    monkeypatch.setattr(E._Log, "drop", lambda *_: None)
    w = writer(tmp_path, Counted(), lease=0.5)
    with pytest.raises(RuntimeError):
        w.task(iter([batch(5000)]), 0, 0)
    monkeypatch.undo()
    second, third = w.task(iter([batch(5000)]), 0, 1), w.task(iter([batch(5000)]), 0, 2)
    assert sorted(second.files) == sorted(third.files) and len(second.files) == 3
    w.commit([third])
    found = shown(tmp_path)
    assert len(found) == 5000 and sum(r["status"] == 201 for r in found.values()) >= 4500 and found[4999]["error"] == E.UNKNOWN
    assert {p.name[:5] for p in (tmp_path / "responses").iterdir()} == {"part-"}
