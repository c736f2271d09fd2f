"""Requests of a task: many under way at once, few to a host, none that waits for a thread's sleep.

A host has PER_HOST lanes; a request's id tells its lane. All requests of a lane are one task's, which has one of them under way at a time, so a host's
bound holds over all tasks. A host's lanes are different tasks' where there are twice as many tasks. Threads only send: a request that waits, for its lane or until it is
tried again, is a row in a queue. A thread sends a lane's next requests one after another while they are answered at once.
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Requests of a task that are under way at once, lanes of a host, requests that a task has taken and not answered.
AT_ONCE, PER_HOST, WINDOW = 16, 4, 8192
#: Requests of a lane that a thread takes at a time, and seconds after which it begins no further one.
IN_TURN, TURN_S = 64, 0.01


@dataclass
class Job:
    id: Any
    row: dict[str, Any] | None
    lane: str
    attempt: int = 0
    started: float = 0.0
    response: dict[str, Any] | None = None


#: Tries a job once. It sets the job's response and returns None, or the seconds after which the job is to be tried again.
Try = Callable[[Job], float | None]


def answered(jobs: Iterator[Job], attempt: Try, at_once: int = AT_ONCE, window: int = WINDOW) -> Iterator[Job]:
    """The jobs in the order in which they end. Jobs are read only when a thread is free and nothing that was read may run.

    After an error no job is begun, and those that have ended or are under way are given before it is raised.
    """
    waiting: dict[str, deque[Job]] = {}
    busy: set[str] = set()
    ready: deque[str] = deque()
    later: list[tuple[float, int, Job]] = []
    ended: deque[Job] = deque()
    turn, held, more = count(), 0, True
    error: Exception | None = None

    def put(job: Job) -> None:
        queue = waiting.setdefault(job.lane, deque())
        queue.append(job)
        if len(queue) == 1 and job.lane not in busy:
            ready.append(job.lane)

    def take() -> list[Job]:
        if not ready:
            return []
        lane = ready.popleft()
        busy.add(lane)
        queue = waiting[lane]
        jobs = [queue.popleft() for _ in range(min(IN_TURN, len(queue)))]
        if not queue:
            del waiting[lane]
        return jobs

    def run(jobs: list[Job]) -> tuple[list[float | None], Exception | None]:
        """What the attempts at the first jobs said; the others weren't begun."""
        said: list[float | None] = []
        until = time.monotonic() + TURN_S
        for job in jobs:
            try:
                said.append(attempt(job))
            except Exception as e:  # noqa: BLE001
                return said, e
            if error is not None or time.monotonic() > until:
                break
        return said, None

    under_way: dict[Future, list[Job]] = {}
    with ThreadPoolExecutor(at_once) as pool:
        while more or held or ended:
            while later and later[0][0] <= time.monotonic():
                put(heapq.heappop(later)[2])
            while error is None and len(under_way) < at_once:
                taken = take()
                if taken:
                    under_way[pool.submit(run, taken)] = taken
                elif more and held < window:
                    job = next(jobs, None)
                    more = job is not None
                    if job is not None:
                        held += 1
                        job.started = time.monotonic()
                        put(job)
                else:
                    break
            while ended:
                yield ended.popleft()
            if error is not None and not under_way:
                raise error
            rest = max(0.0, later[0][0] - time.monotonic()) if later else None
            if not under_way:
                if rest is not None:
                    time.sleep(rest)
                continue
            for future in wait(under_way, rest, FIRST_COMPLETED).done:
                jobs_taken = under_way.pop(future)
                lane = jobs_taken[0].lane
                said, failed = future.result()
                error = error or failed
                for job, again in zip(jobs_taken, said, strict=False):
                    if again is None:
                        held -= 1
                        ended.append(job)
                    else:
                        job.attempt += 1
                        heapq.heappush(later, (time.monotonic() + again, next(turn), job))
                if len(said) < len(jobs_taken):
                    waiting.setdefault(lane, deque()).extendleft(reversed(jobs_taken[len(said) :]))
                busy.discard(lane)
                if lane in waiting:
                    ready.append(lane)


def batches(jobs: Iterator[Job], most_rows: int = 64, most_bytes: int = 1 << 24) -> Iterator[list[Job]]:
    """Jobs by so many, or fewer with long bodies; those before an error are given before it is raised."""
    held: list[Job] = []
    n = 0
    error: Exception | None = None
    try:
        for job in jobs:
            held.append(job)
            n += len((job.response or {}).get("body") or b"")
            if len(held) >= most_rows or n >= most_bytes:
                yield held
                held, n = [], 0
    except Exception as e:  # noqa: BLE001
        error = e
    if held:
        yield held
    if error is not None:
        raise error


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://([^/?#]*)", 1))


def _number_of(request_id: Column) -> Column:
    return F.pmod(F.xxhash64(request_id), F.lit(PER_HOST))


def lane_of(request_id: Column, url: Column) -> Column:
    return F.concat_ws("#", host_of(url), _number_of(request_id).cast("string"))


def dealt(requests: DataFrame, tasks: int | None = None) -> DataFrame:
    """request_id, request, lane: the lanes dealt to tasks, a task's requests in an order that mixes its hosts."""
    n = tasks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    request_id, url = F.col("request_id"), F.col("request.url")
    if n < 2 * PER_HOST:
        rows = requests.select("request_id", "request", lane_of(request_id, url).alias("lane"))
        return rows.repartition(n, "lane").sortWithinPartitions(F.xxhash64("request_id"))
    # A host's lanes go to tasks beside one another.
    task = F.pmod(F.pmod(F.xxhash64(host_of(url)), F.lit(n)) + _number_of(request_id), F.lit(n)).cast("int")
    rows = requests.select("request_id", "request", lane_of(request_id, url).alias("lane"), task.alias("task"))
    return rows.repartitionById(n, "task").drop("task").sortWithinPartitions(F.xxhash64("request_id"))
