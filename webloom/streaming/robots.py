"""Robots verdicts over streams: an origin's file is kept for its time to live, and pages that come before it wait for it.

State is an origin's (its file, and the pages that wait), in the state store that the session names; it has to be the RocksDB one
(``spark.sql.streaming.stateStore.providerClass``), which keeps lists on disk. Times are those of the rows, as far as the watermark has come.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from webloom.functions import kernels as K
from webloom.kernel.robots import RobotsFile, parse_robots
from webloom.operators.robots import ABSENT, MOST_BYTES

NOT_IN_TIME = "no robots.txt came in time -- crawl permitted by default"
_FILE = "status int, body string, seen_ms long"
_PAGE = "page_id long, path string, agent string, seen_ms long"
VERDICTS = "page_id long, origin string, path string, user_agent string, allowed boolean, matched_rule string, crawl_delay double, status int, note string, error string"


def _verdict(origin: str, page: Any, file: Any | None, rules: RobotsFile | None) -> Row:
    """The row of a page; without a file, or where none was found, all is allowed, and a file that couldn't be had is an error."""
    out = {"page_id": page["page_id"], "origin": origin, "path": page["path"], "user_agent": page["agent"], "allowed": True, "matched_rule": None, "crawl_delay": None, "status": None, "note": NOT_IN_TIME, "error": None}
    if file is not None:
        status = file["status"]
        out |= {"status": status, "note": ABSENT if status == 404 else None}
        if 200 <= status < 300:
            found = rules.verdict(page["agent"] or "", page["path"])
            if found["allow"] is not None:
                out |= {"allowed": found["allow"], "matched_rule": ("Allow: " if found["allow"] else "Disallow: ") + found["path"]}
            out["crawl_delay"] = found["crawl_delay"]
        elif status != 404:
            out |= {"allowed": None, "error": f"HTTP {status}"}
    return Row(**out)


class _Cache(StatefulProcessor):
    def __init__(self, ttl_ms: int, patience_ms: int) -> None:
        self.ttl_ms, self.patience_ms = ttl_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", _FILE)
        self.held = handle.getListState("held", _PAGE)

    def _known(self) -> tuple[Any | None, RobotsFile | None]:
        if not self.file.exists():
            return None, None
        status, body, seen = self.file.get()
        file = {"status": status, "body": body, "seen_ms": seen}
        return file, RobotsFile(parse_robots(body or "")["groups"]) if 200 <= status < 300 else None

    def _waiting(self) -> list[dict[str, Any]]:
        return [dict(zip(("page_id", "path", "agent", "seen_ms"), p, strict=True)) for p in self.held.get()] if self.held.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest, pages = None, []
        for r in rows:
            if r["is_file"]:
                newest = max(newest or (r["seen_ms"], r["status"], r["body"] or ""), (r["seen_ms"], r["status"], r["body"] or ""))
            else:
                pages.append({"page_id": r["page_id"], "path": r["path"], "agent": r["agent"], "seen_ms": r["seen_ms"]})
        file, rules = self._known()
        if newest is not None and (file is None or newest[0] >= file["seen_ms"]):
            self.file.update((newest[1], newest[2], newest[0]))
            self.handle.registerTimer(newest[0] + self.ttl_ms)
            file, rules = self._known()
        # A file serves the pages that waited for it, and those seen while it lives.
        fits = lambda p: file is not None and p["seen_ms"] < file["seen_ms"] + self.ttl_ms
        waiting = self._waiting() if newest is not None else []
        still = [p for p in waiting if not fits(p)]
        if waiting:
            self.held.clear()
            if still:
                self.held.put([tuple(p.values()) for p in still])
        for p in waiting:
            if fits(p):
                yield _verdict(key[0], p, file, rules)
        for p in pages:
            if fits(p):
                yield _verdict(key[0], p, file, rules)
            else:
                self.held.appendValue(tuple(p.values()))
                self.handle.registerTimer(p["seen_ms"] + self.patience_ms)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        file, _ = self._known()
        if file is not None and file["seen_ms"] + self.ttl_ms <= now:
            self.file.clear()
        waiting = self._waiting()
        due = [p for p in waiting if p["seen_ms"] + self.patience_ms <= now]
        if due:
            still = [p for p in waiting if p["seen_ms"] + self.patience_ms > now]
            self.held.clear()
            if still:
                self.held.put([tuple(p.values()) for p in still])
        for p in due:
            yield _verdict(key[0], p, None, None)

    def close(self) -> None:
        pass


def robots_verdicts(pages: DataFrame, files: DataFrame, ttl_s: int = 86_400, patience_s: int = 3_600, watermark: str = "10 minutes", user_agent: str = "*", shares: int = 1) -> DataFrame:
    """Verdicts for a stream of pages (page_id, url, seen_at, agent if there is one) by a stream of files (origin, status, body, seen_at).

    A page is judged by the newest file of its origin that is no older than ``ttl_s``; without one it waits until one comes, ``patience_s`` at most. ``shares`` deals the
    pages of each origin to so many states, each with the origin's file, where one origin has very many.
    """
    agent = F.col("agent") if "agent" in pages.columns else F.lit(user_agent)
    ms = F.unix_millis("seen_at").alias("seen_ms")
    parts = pages.select("page_id", "seen_at", agent.alias("agent"), K.url_parts("url")["value"].alias("u"))
    asked = parts.where("u is not null").select(
        F.col("u.origin").alias("origin"), F.pmod(F.xxhash64("page_id"), F.lit(shares)).cast("int").alias("share"), F.lit(False).alias("is_file"), "seen_at", ms,
        F.col("page_id").cast("long").alias("page_id"), F.concat("u.pathname", "u.search").alias("path"), "agent", F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("body"),
    )
    text = F.make_valid_utf8(F.substring(F.coalesce("body", F.lit("")).cast("binary"), 1, MOST_BYTES).cast("string"))
    known = files.select(
        "origin", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(True).alias("is_file"), "seen_at", ms,
        F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("agent"), F.col("status").cast("int").alias("status"), text.alias("body"),
    )
    rows = asked.unionByName(known).withWatermark("seen_at", watermark)
    return rows.groupBy("origin", "share").transformWithState(_Cache(ttl_s * 1000, patience_s * 1000), VERDICTS, "append", "eventTime")
