"""``webloom_http``: requests and responses as a data source, read and written by Spark's own reader and writer.

    spark.dataSource.register(HttpSource)
    stage_requests(requests, path); spark.read.format("webloom_http").options(**http_options(path, transport)).load()
    requests.write.format("webloom_http").options(**http_options(log, transport)).mode("append").save()

Reading plans a partition for each task's share of the hosts' lanes; the requests lie in a folder for each. Writing submits each request at
most once: only a task's first attempt sends. What it has got is stored as it goes; a later attempt (after a loss, or a speculative copy)
never sends, and waits as long as the first gives signs of life (pieces of 64 responses are stored as they come, 64 pieces become a table). Then it answers as the first did, or takes what that one had stored and says of the others that it
isn't known whether they were sent. Responses become visible when all tasks have ended; a job that is given up shows what it had got.

Folders are reached through pyarrow's file systems (local paths, ``file:``, ``hdfs:``, ``s3:``); others give an error when the plan is made.
"""

from __future__ import annotations

import base64
import contextlib
import json
import threading
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from webloom.cut import written
from webloom.functions.schemas import RESPONSE
from webloom.sources.http import NOT_IDEMPOTENT, UNKNOWN, Raw, Refused, Transport, failure, jobs_of, response_batch, response_type, tries
from webloom.sources.lanes import Job, answered, batches, dealt

#: Seconds between signs of life of a task that sends, and without one after which it counts as lost.
BEAT_S, LEASE_S = 1.0, 30.0
#: Pieces (64 responses each), and their bytes, that a sending task stores before they become one table; rows of a table of requests that weren't sent again.
PIECES, PIECES_BYTES, UNKNOWN_ROWS = 64, 32 << 20, 4096


def http_options(path: str, transport: Transport | None = None, lease_s: float = LEASE_S, id_type: str = "bigint") -> dict[str, str]:
    packed = base64.b64encode(cloudpickle.dumps(transport or Refused())).decode()
    return {"path": path, "transport": packed, "lease_s": str(lease_s), "id_type": id_type}


def _transport(options: dict[str, str]) -> Transport:
    return cloudpickle.loads(base64.b64decode(options["transport"])) if "transport" in options else Refused()


class HttpSource(DataSource):
    """The source and sink. Options: see ``http_options``; without a transport nothing is reached."""

    @classmethod
    def name(cls) -> str:
        return "webloom_http"

    def schema(self) -> str:
        return f"request_id {self.options.get('id_type', 'bigint')}, response {RESPONSE.simpleString()}"

    def reader(self, schema: T.StructType) -> HttpReader:
        return HttpReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> HttpWriter:
        if overwrite:
            raise ValueError("what was sent can't be taken back: append to the log")
        return HttpWriter(dict(self.options), schema)


# Reading


def stage_requests(requests: DataFrame, path: str, tasks: int | None = None) -> None:
    """Writes requests (request_id, request) for the reader: a folder for each task, dealt by hosts' lanes."""
    rows = dealt(requests, tasks)
    rows.withColumn("task", F.spark_partition_id()).write.partitionBy("task").parquet(path)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.options, self.kind = options, schema["request_id"].dataType

    def partitions(self) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.options["path"])
        found = files.get_file_info(fs.FileSelector(root))
        return [InputPartition(f.path) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("task=")] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        rows = ds.dataset(partition.value, format="parquet", filesystem=files).to_batches(batch_size=1024, batch_readahead=1, fragment_readahead=1)
        for done in batches(answered(jobs_of(rows), tries(_transport(self.options), NOT_IDEMPOTENT))):
            yield response_batch(done, self.kind)


#: Rows of a bucket of captured responses, about, and of a row group, at most; footers of buckets that a process keeps.
BUCKET_ROWS, GROUP_ROWS, BUCKETS_KEPT = 1000, 16, 512


@lru_cache(BUCKETS_KEPT)
def _bucket(path: str, n: int) -> list[tuple[str, pq.FileMetaData, list[tuple[str, str] | None]]]:
    """The files of a bucket, their footers, and the least and the greatest URL of each row group; very long ones have none. What is staged doesn't change."""
    files, root = fs.FileSystem.from_uri(path)
    out = []
    for f in files.get_file_info(fs.FileSelector(f"{root}/bucket={n}", allow_not_found=True)):
        if f.base_name.endswith(".parquet"):
            with files.open_input_file(f.path) as source:
                footer = pq.read_metadata(source)
            place = footer.schema.names.index("url")
            known = [footer.row_group(i).column(place).statistics for i in range(footer.num_row_groups)]
            out.append((f.path, footer, [(k.min, k.max) if k is not None and k.has_min_max else None for k in known]))
    return out


class CapturedTable:
    """A transport that replays responses of a table that ``stage_captured`` wrote. A lookup reads the row groups of its URL's bucket that may hold it, so it costs
    the same however many responses there are, and no task holds a host."""

    def __init__(self, path: str, buckets: int) -> None:
        self.path, self.buckets, self.sent = path, buckets, {}

    def resolve(self, host: str) -> list[str]:
        return ["93.184.216.34"]

    def send(self, method: str, url: Any, address: str, headers: dict[str, str], body: bytes | None, timeout_s: float, max_bytes: int) -> Raw:
        n = self.sent[method, str(url)] = self.sent.get((method, str(url)), -1) + 1
        rows = [r for r in self.captured(str(url)) if r["method"] == method]
        row = next((r for wanted in (n, 0) for r in rows if r["attempt"] == wanted), None)
        if row is None:
            raise OSError(f"no response captured for {method} {url}")
        return Raw(row["status"], row["status_text"] or "", dict(row["headers"] or []), (row["body"] or b"")[: max_bytes + 1])

    def captured(self, url: str) -> list[dict[str, Any]]:
        """All responses of a URL."""
        files, _ = fs.FileSystem.from_uri(self.path)
        rows: list[dict[str, Any]] = []
        for path, footer, bounds in _bucket(self.path, bucket_of(url, self.buckets)):
            if found := [i for i, ends in enumerate(bounds) if ends is None or ends[0] <= url <= ends[1]]:
                with files.open_input_file(path) as source:
                    table = pq.ParquetFile(source, metadata=footer).read_row_groups(found, use_threads=False)
                rows += table.filter(pc.equal(table["url"], url)).to_pylist()
        return rows


def bucket_of(url: str, buckets: int) -> int:
    return zlib.crc32(url.encode()) % buckets


def stage_captured(responses: DataFrame, path: str, buckets: int | None = None) -> CapturedTable:
    """Writes responses (method, url, attempt, status, status_text, headers, body) by their URLs in buckets, each in order of URL, in small row groups.

    If no number of buckets is given, it follows the number of rows.
    """
    n = buckets or responses.count() // BUCKET_ROWS + 1
    rows = responses.withColumn("bucket", (F.crc32(F.col("url").cast("binary")) % n).cast("int"))
    tasks = int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "url")
    small = {"parquet.block.size": str(1 << 18), "parquet.page.size.row.check.min": "16", "parquet.block.row.count.limit": str(GROUP_ROWS)}
    rows.write.options(**small).partitionBy("bucket").parquet(path)
    return CapturedTable(path, n)


# Writing


@dataclass
class Sent(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class _Log:
    """The files of one job under the log's folder of responses; Spark's readers pass over names that begin with a dot."""

    def __init__(self, path: str, job: str) -> None:
        self.files, root = fs.FileSystem.from_uri(path)
        self.folder, self.job = f"{root}/responses", job

    def put(self, name: str, data: bytes) -> None:
        """Writes a file that is there whole or not at all."""
        aside = f"{self.folder}/.writing-{uuid.uuid4().hex}"
        with self.files.open_output_stream(aside) as f:
            f.write(data)
        self.files.move(aside, f"{self.folder}/{name}")

    def get(self, name: str) -> bytes | None:
        try:
            with self.files.open_input_stream(f"{self.folder}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def name(self, partition: int, attempt: int, first: int, last: int, kind: str = "parquet") -> str:
        """A table of an attempt's pieces first to last, or one piece (``arrow``)."""
        return f".pending-{self.job}-{partition}-{attempt}-{first}-{last}.{kind}"

    def stored(self) -> dict[int, list[tuple[int, int, int, str]]]:
        """attempt, first, last and name of what the partitions have stored."""
        found: dict[int, list[tuple[int, int, int, str]]] = {}
        start = f".pending-{self.job}-"
        for f in self.files.get_file_info(fs.FileSelector(self.folder)):
            if f.base_name.startswith(start):
                partition, *numbers = map(int, f.base_name.removeprefix(start).partition(".")[0].split("-"))
                found.setdefault(partition, []).append((*numbers, f.base_name))
        return found

    def pending(self, partition: int) -> tuple[list[str], list[tuple[int, str]]]:
        """A partition's tables, and the pieces (number, name) that are in none of them. Of two tables with the same piece the longer one counts."""
        tables, pieces, seen = [], [], set()
        found = sorted(self.stored().get(partition, []), key=lambda f: (f[0], f[1], -f[2]))
        for kind in ("parquet", "arrow"):
            for attempt, first, last, name in found:
                numbers = {(attempt, i) for i in range(first, last + 1)}
                if name.endswith(kind) and not numbers & seen:
                    seen |= numbers
                    if kind == "parquet":
                        tables.append(name)
                    else:
                        pieces.append((first, name))
        return tables, pieces

    def drop(self, names: list[str]) -> None:
        for name in names:
            with contextlib.suppress(FileNotFoundError):
                self.files.delete_file(f"{self.folder}/{name}")

    def publish(self, names: list[str]) -> None:
        for name in names:
            self.files.move(f"{self.folder}/{name}", f"{self.folder}/part-{name.removeprefix('.pending-')}")

    def clear(self) -> None:
        for f in self.files.get_file_info(fs.FileSelector(self.folder)):
            if f.base_name.startswith((f".beat-{self.job}-", f".done-{self.job}-")) or f.base_name.startswith(f".pending-{self.job}-") and f.base_name.endswith(".arrow"):
                self.drop([f.base_name])


class HttpWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.options, self.job = options, uuid.uuid4().hex
        self.kind = schema["request_id"].dataType

    def _store(self, log: _Log, name: str, batches: list[pa.RecordBatch]) -> None:
        sink = pa.BufferOutputStream()
        if name.endswith("arrow"):
            with pa.ipc.new_stream(sink, batches[0].schema) as out:
                out.write_batch(batches[0])
        else:
            pq.write_table(pa.Table.from_batches(batches), sink)
        log.put(name, sink.getvalue().to_pybytes())

    def _gathered(self, log: _Log, partition: int) -> list[str]:
        """The tables of all that a partition has stored; pieces become one."""
        while True:
            tables, pieces = log.pending(partition)
            found = [log.get(name) for _, name in pieces]
            # A first attempt that was only slow may just have made a table of them.
            if None not in found:
                break
        if pieces:
            name = log.name(partition, 0, pieces[0][0], pieces[-1][0])
            self._store(log, name, [b for data in found for b in pa.ipc.open_stream(data)])
            log.drop([name for _, name in pieces])
            tables.append(name)
        return tables

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        context = TaskContext.get()
        return self.task(iterator, context.partitionId(), context.attemptNumber())

    def task(self, rows: Iterator[pa.RecordBatch], partition: int, attempt: int) -> Sent:
        log = _Log(self.options["path"], self.job)
        return self._again(log, rows, partition, attempt) if attempt else self._first(log, rows, partition)

    def _first(self, log: _Log, rows: Iterator[pa.RecordBatch], partition: int) -> Sent:
        over, names = threading.Event(), []
        held: list[pa.RecordBatch] = []
        first = 0

        def table() -> None:
            names.append(log.name(partition, 0, first, first + len(held) - 1))
            self._store(log, names[-1], held)
            log.drop([log.name(partition, 0, i, i, "arrow") for i in range(first, first + len(held) - 1)])

        def beat() -> None:
            while True:
                log.put(f".beat-{self.job}-{partition}", uuid.uuid4().bytes)
                if over.wait(BEAT_S):
                    return

        alive = threading.Thread(target=beat, daemon=True)
        alive.start()
        try:
            for done in batches(answered(jobs_of(rows), tries(_transport(self.options)))):
                held.append(response_batch(done, self.kind))
                if len(held) < PIECES and sum(b.nbytes for b in held) < PIECES_BYTES:
                    i = first + len(held) - 1
                    self._store(log, log.name(partition, 0, i, i, "arrow"), held[-1:])
                else:
                    table()
                    first, held = first + len(held), []
            if held:
                table()
                log.drop([log.name(partition, 0, first + len(held) - 1, first + len(held) - 1, "arrow")])
            log.put(f".done-{self.job}-{partition}", json.dumps(names).encode())
        finally:
            over.set()
            alive.join()
        return Sent(names)

    def _again(self, log: _Log, rows: Iterator[pa.RecordBatch], partition: int, attempt: int) -> Sent:
        lease = float(self.options.get("lease_s", LEASE_S))
        seen, since = None, time.monotonic()
        while (done := log.get(f".done-{self.job}-{partition}")) is None:
            sign = log.get(f".beat-{self.job}-{partition}")
            if sign != seen:
                seen, since = sign, time.monotonic()
            elif time.monotonic() - since > lease:
                break
            time.sleep(min(BEAT_S, lease / 4))
        if done is not None:
            return Sent(json.loads(done))
        names = self._gathered(log, partition)
        known = {x for n in names for x in pq.read_table(pa.BufferReader(log.get(n)), columns=["request_id"])["request_id"].to_pylist()}
        # Further files may come from a first attempt that was only slow; they stay hidden.
        started = time.monotonic()
        lost = (Job(j.id, None, "", response=failure((j.row or {}).get("url") or "", UNKNOWN, [], started)) for j in jobs_of(rows) if j.id not in known)
        for i, unknown in enumerate(batches(lost, UNKNOWN_ROWS)):
            names.append(name := log.name(partition, attempt, i, i))
            self._store(log, name, [response_batch(unknown, self.kind)])
        return Sent(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        log = _Log(self.options["path"], self.job)
        log.publish([n for m in messages if m is not None for n in m.files])
        log.clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What was answered is shown; the rest stays open, and the log's next call says so."""
        log = _Log(self.options["path"], self.job)
        for partition in log.stored():
            log.publish(self._gathered(log, partition))
        log.clear()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)


def send(requests: DataFrame, transport: Transport, log: str, tasks: int | None = None, lease_s: float = LEASE_S) -> DataFrame:
    """As fetch, for any method: a sink that submits each request at most once. The Parquet tables under ``log`` tell what became of it.

    ``intents`` has a request's id before anything is sent, ``responses`` its response after. A request with an intent is never
    sent again: one whose job ended without a response, or whose task was lost while it was under way, gets a response of status 0 that
    says UNKNOWN. Repeated ids are one request, any of theirs. One call at a time may write to a log.
    """
    spark = requests.sparkSession
    register(spark)
    kind = requests.schema["request_id"].dataType
    ids, answers = T.StructType([T.StructField("request_id", kind)]), response_type(kind)
    for name, schema in (("intents", ids), ("responses", answers)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{log}/{name}")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{log}/{name}")
    # What an earlier call left open stays open.
    lost = written(read("intents", ids).join(read("responses", answers).select("request_id"), "request_id", "left_anti"), "lost")
    url = lost.join(requests.dropDuplicates(["request_id"]), "request_id", "left").select("request_id", F.coalesce("request.url", F.lit("")).alias("url"))
    _unknown(url, answers).write.mode("append").parquet(f"{log}/responses")
    # A written table: no shuffle is behind the requests whose loss would run sent ones again as a first attempt.
    new = written(dealt(requests.dropDuplicates(["request_id"]).join(read("intents", ids), "request_id", "left_anti"), tasks).withColumn("task", F.spark_partition_id()), "requests")
    new.select("request_id").write.mode("append").parquet(f"{log}/intents")
    new.select("request_id", "request", "lane").write.format("webloom_http").options(**http_options(log, transport, lease_s, kind.simpleString())).mode("append").save()
    return read("responses", answers)


def _unknown(rows: DataFrame, answers: T.StructType) -> DataFrame:
    """Responses for rows (request_id, url) of which it isn't known whether they were sent."""
    known = {"ok": F.lit(False), "status": F.lit(0), "status_text": F.lit(""), "headers": F.create_map().cast("map<string,string>"), "url": F.col("url"), "redirects": F.array().cast("array<string>"), "truncated": F.lit(False), "duration_ms": F.lit(0), "error": F.lit(UNKNOWN)}
    fields = answers["response"].dataType.fields
    return rows.select("request_id", F.struct(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)).alias("response"))
