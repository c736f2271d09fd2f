"""Fetching: a request's way over hops and attempts, with an injected transport.

Nothing is reached unless a transport is given. Fetching writes its responses before anything reads them, so that no
request is sent again because a plan is evaluated again; requests that aren't idempotent take the sink instead
(``webloom.sources.exchange``).
"""

from __future__ import annotations

import base64
import contextlib
import http.client
import json
import socket
import ssl
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webloom import __version__
from webloom.cut import written
from webloom.functions import http as rules
from webloom.functions.kernels import plain
from webloom.functions.schemas import BOOLEAN, LONG, ONE_EACH, RESPONSE, STRING, record
from webloom.kernel.bodies import decode_bytes, is_json_type, is_text_type
from webloom.kernel.net import NO_URL, answers_refusal, refusal
from webloom.kernel.url import Url, UrlError, parse
from webloom.sources.lanes import Job, answered, batches, dealt

#: Limits and their defaults.
TIMEOUT_MS, MAX_BYTES, MOST_BYTES, MAX_REDIRECTS, MOST_REDIRECTS, MOST_RETRIES = 10_000, 5 << 20, 100 << 20, 5, 20, 5
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
NOT_IDEMPOTENT = ("POST", "PATCH")
NO_BODY = ("GET", "HEAD")
#: The error of a request of which it isn't known whether it was sent.
UNKNOWN = "whether it was sent is not known: its task or job was lost; not sent again"


def user_agent(version: str = __version__, about: str | None = None) -> str:
    return f"webloom/{version}" + (f" (+{about})" if about else "")


USER_AGENT = user_agent()

REQUEST = record(
    method=STRING,
    url=STRING,
    headers=ONE_EACH,
    body=T.BinaryType(),
    content_type=STRING,
    timeout_ms=LONG,
    max_bytes=LONG,
    max_redirects=LONG,
    allow_private_hosts=BOOLEAN,
    basic_auth=record(username=STRING, password=STRING),
    bearer_token=STRING,
    decode_text=BOOLEAN,
    user_agent=STRING,
    retries=LONG,
)


@dataclass(frozen=True)
class Request:
    url: str
    method: str = "GET"
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes | None = None
    content_type: str | None = None
    timeout_ms: int = TIMEOUT_MS
    max_bytes: int = MAX_BYTES
    max_redirects: int = MAX_REDIRECTS
    allow_private_hosts: bool = False
    basic_auth: tuple[str, str] | None = None
    bearer_token: str | None = None
    decode_text: bool | None = None
    user_agent: str | None = None
    retries: int = 0

    @classmethod
    def of(cls, row: dict[str, Any]) -> Request:
        """From a row of options; ``body_json`` goes before ``body`` and is JSON by default. Raises ValueError."""
        given = {k: v for k, v in row.items() if v is not None and k in cls.__dataclass_fields__}
        if row.get("body_json") is not None:
            value = row["body_json"]
            given["body"] = (value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))).encode()
            given.setdefault("content_type", "application/json")
        if isinstance(given.get("body"), str):
            given["body"] = given["body"].encode()
        if isinstance(given.get("headers"), list):
            given["headers"] = dict(given["headers"])
        if isinstance(given.get("basic_auth"), dict):
            given["basic_auth"] = given["basic_auth"]["username"], given["basic_auth"]["password"]
        given["max_bytes"] = min(given.get("max_bytes", MAX_BYTES), MOST_BYTES)
        made = cls(**given)
        if made.method not in METHODS:
            raise ValueError(f"method {made.method} is not known")
        if not 0 <= made.max_redirects <= MOST_REDIRECTS or not 0 <= made.retries <= MOST_RETRIES:
            raise ValueError("too many redirects or retries")
        return made


@dataclass(frozen=True)
class Raw:
    """What a transport gives for one hop; at most one byte more of the body than was asked for."""

    status: int
    status_text: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


class Transport(Protocol):
    def resolve(self, host: str) -> list[str]: ...

    def send(self, method: str, url: Url, address: str, headers: dict[str, str], body: bytes | None, timeout_s: float, max_bytes: int) -> Raw: ...


class Refused:
    """The default transport: reaches nothing."""

    def resolve(self, host: str) -> list[str]:
        raise OSError("no transport is given")

    def send(self, *_: Any) -> Raw:
        raise OSError("no transport is given")


class Captured:
    """Replays responses (method, url, attempt, status, status_text, headers, body); attempts of a URL count from 0."""

    def __init__(self, rows: list[dict[str, Any]], answers: dict[str, list[str]] | None = None) -> None:
        self.rows = {(r.get("method") or "GET", r["url"], r.get("attempt") or 0): r for r in rows}
        self.answers, self.sent = answers or {}, {}

    def resolve(self, host: str) -> list[str]:
        return self.answers.get(host, ["93.184.216.34"])

    def send(self, method: str, url: Url, address: str, headers: dict[str, str], body: bytes | None, timeout_s: float, max_bytes: int) -> Raw:
        n = self.sent[method, str(url)] = self.sent.get((method, str(url)), -1) + 1
        row = self.rows.get((method, str(url), n)) or self.rows.get((method, str(url), 0))
        if row is None:
            raise OSError(f"no response captured for {method} {url}")
        found = row.get("body") or b""
        return Raw(row["status"], row.get("status_text") or "", dict(row.get("headers") or {}), (found.encode() if isinstance(found, str) else bytes(found))[: max_bytes + 1])


class Network:
    """Connects to the address that was checked, under the URL's own name. A hop ends at its deadline, however slowly it goes on, and so does a lookup of a name."""

    resolve_s = TIMEOUT_MS / 1000

    def resolve(self, host: str) -> list[str]:
        found: list[Any] = []

        def look_up() -> None:
            try:
                found.append(socket.getaddrinfo(host, None, type=socket.SOCK_STREAM))
            except OSError as e:
                found.append(e)

        asked = threading.Thread(target=look_up, daemon=True)
        asked.start()
        asked.join(self.resolve_s)
        if not found:
            raise OSError(f"no answer within {self.resolve_s:g}s")
        if isinstance(found[0], OSError):
            raise found[0]
        return list(dict.fromkeys(a[4][0] for a in found[0]))

    def send(self, method: str, url: Url, address: str, headers: dict[str, str], body: bytes | None, timeout_s: float, max_bytes: int) -> Raw:
        port = url.port or (443 if url.scheme == "https" else 80)
        began = time.monotonic()
        link = socket.create_connection((address, port), timeout_s)
        late = threading.Event()

        def end() -> None:
            late.set()
            with contextlib.suppress(OSError):
                link.shutdown(socket.SHUT_RDWR)

        watch = threading.Timer(max(0.0, timeout_s - (time.monotonic() - began)), end)
        watch.daemon = True
        watch.start()
        connection = http.client.HTTPConnection(url.netloc, timeout=timeout_s)
        try:
            connection.sock = ssl.create_default_context().wrap_socket(link, server_hostname=url.host) if url.scheme == "https" else link
            connection.request(method, url.pathname + url.search, body, {"host": url.netloc, **headers})
            response = connection.getresponse()
            data = b"" if method == "HEAD" else response.read(max_bytes + 1)
            if late.is_set():
                raise TimeoutError
            return Raw(response.status, response.reason, {k: v for k, v in response.getheaders()}, data)
        except (OSError, http.client.HTTPException) as e:
            raise TimeoutError from e if late.is_set() else e
        finally:
            watch.cancel()
            connection.close()
            link.close()


def retry_after_ms(header: str | None, now_ms: int) -> int | None:
    value = (header or "").strip()
    try:
        seconds = float(value)
        if 0 <= seconds < float("inf"):
            return int(min(seconds * 1000, rules.MOST_RETRY_AFTER_MS))
    except ValueError:
        pass
    try:
        return int(max(0, min(parsedate_to_datetime(value).timestamp() * 1000 - now_ms, rules.MOST_RETRY_AFTER_MS)))
    except (ValueError, TypeError):
        return None


def request_headers(request: Request, method: str, has_body: bool, strip_auth: bool) -> dict[str, str]:
    """The headers of a hop, in lower case. Credentials don't follow to another origin."""
    h = {k.lower(): v for k, v in request.headers.items()}
    h.setdefault("user-agent", request.user_agent or USER_AGENT)
    h.setdefault("accept", "*/*")
    if strip_auth:
        h.pop("authorization", None)
    elif request.basic_auth:
        h["authorization"] = "Basic " + base64.b64encode(":".join(request.basic_auth).encode()).decode()
    elif request.bearer_token:
        h["authorization"] = f"Bearer {request.bearer_token}"
    if not has_body:
        h.pop("content-type", None)
    elif request.content_type:
        h.setdefault("content-type", request.content_type)
    return h


def failure(url: str, error: str, redirects: list[str], started: float) -> dict[str, Any]:
    return {"ok": False, "status": 0, "status_text": "", "headers": {}, "url": url, "redirects": redirects, "truncated": False, "duration_ms": int((time.monotonic() - started) * 1000), "error": error}


def _response(request: Request, method: str, url: Url, raw: Raw, redirects: list[str], started: float) -> dict[str, Any]:
    headers = {k.lower(): v for k, v in raw.headers.items()}
    kind = headers.get("content-type", "")
    body, truncated = raw.body[: request.max_bytes], len(raw.body) > request.max_bytes
    out = {"ok": 200 <= raw.status < 300, "status": raw.status, "status_text": raw.status_text, "headers": headers, "url": str(url), "redirects": redirects}
    out |= {"truncated": truncated, "duration_ms": int((time.monotonic() - started) * 1000), "error": None}
    if method != "HEAD":
        out["body"] = body
        as_text = is_text_type(kind) if request.decode_text is None else request.decode_text
        if as_text:
            out["body_text"] = decode_bytes(body, kind)
            if is_json_type(kind) and out["body_text"] and not truncated:
                try:
                    out["json"] = json.dumps(json.loads(out["body_text"]), ensure_ascii=False)
                except ValueError:
                    pass
        else:
            out["body_base64"] = base64.b64encode(body).decode()
    return out


Clock = Callable[[], int]


def _now_ms() -> int:
    return int(time.time() * 1000)


def retry_wait_s(request: Request, attempt: int, response: dict[str, Any], now_ms: Clock = _now_ms) -> float | None:
    """The seconds to wait before a request is tried again; None if its response is the last."""
    if response["status"] not in rules.RETRY_STATUSES or attempt >= request.retries:
        return None
    asked = retry_after_ms(response["headers"].get("retry-after"), now_ms())
    return (min(2**attempt * rules.FIRST_BACKOFF_MS, rules.MOST_BACKOFF_MS) if asked is None else asked) / 1000


def fetch_one(request: Request, transport: Transport, sleep: Callable[[float], None] = time.sleep, now_ms: Clock = _now_ms) -> dict[str, Any]:
    """The response to a request, after redirects and retries; errors are responses of status 0.

    Every hop's URL is checked, and every address of its host; the connection goes to the first of these.
    """
    started, attempt = time.monotonic(), 0
    while True:
        out = _attempt(request, transport, started)
        wait = retry_wait_s(request, attempt, out, now_ms)
        if wait is None:
            return out
        sleep(wait)
        attempt += 1


def _attempt(request: Request, transport: Transport, started: float) -> dict[str, Any]:
    method, body, target, redirects = request.method, request.body, request.url, []
    first_origin = None
    while True:
        try:
            url = parse(target)
        except UrlError:
            return failure(target, NO_URL, redirects, started)
        if why := refusal(url, request.allow_private_hosts):
            return failure(target, why, redirects, started)
        first_origin = first_origin or url.origin
        host = (url.host or "").strip("[]")
        literal = ":" in host or host.replace(".", "").isdigit()
        try:
            addresses = [host] if literal else transport.resolve(host)
        except OSError as e:
            return failure(target, f'DNS lookup failed for "{host}": {e}', redirects, started)
        if not literal and (not request.allow_private_hosts or not addresses) and (why := answers_refusal(host, addresses)):
            return failure(target, why, redirects, started)
        left = request.timeout_ms / 1000
        sent = None if method in NO_BODY else body
        headers = request_headers(request, method, sent is not None, url.origin != first_origin)
        try:
            raw = transport.send(method, url, addresses[0], headers, sent, left, request.max_bytes)
        except TimeoutError:
            return failure(target, f"request exceeded {request.timeout_ms}ms", redirects, started)
        except (OSError, http.client.HTTPException) as e:
            return failure(target, str(e) or type(e).__name__, redirects, started)
        location = next((v for k, v in raw.headers.items() if k.lower() == "location"), None)
        if not (300 <= raw.status < 400 and location):
            return _response(request, method, url, raw, redirects, started)
        if len(redirects) >= request.max_redirects:
            return failure(target, f"exceeded {request.max_redirects} redirects", redirects, started)
        try:
            target = str(parse(location, url))
        except UrlError:
            return failure(target, f"redirect to an invalid URL: {location}", redirects, started)
        redirects = [*redirects, target]
        if raw.status == 303 or raw.status in (301, 302) and method not in ("GET", "HEAD"):
            method, body = ("HEAD" if method == "HEAD" and raw.status != 303 else "GET"), None


def tries(transport: Transport, refused: tuple[str, ...] = ()) -> Callable[[Job], float | None]:
    """One attempt of a job, as ``answered`` takes it."""

    def one(job: Job) -> float | None:
        try:
            request = Request.of(job.row or {"url": ""})
            if request.method in refused:
                raise ValueError(f"{request.method} is not idempotent: use send")
            job.response = _attempt(request, transport, job.started)
            return retry_wait_s(request, job.attempt, job.response)
        except ValueError as e:
            job.response = failure((job.row or {}).get("url") or "", str(e), [], job.started)
            return None

    return one


def jobs_of(rows: Iterator[pa.RecordBatch]) -> Iterator[Job]:
    """Jobs of batches (request_id, request, lane)."""
    for batch in rows:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            for values in zip(*(part.column(c).to_pylist() for c in ("request_id", "request", "lane")), strict=True):
                yield Job(*values)


def response_batch(jobs: list[Job], kind: T.DataType) -> pa.RecordBatch:
    columns = [pa.array([j.id for j in jobs], to_arrow_type(kind)), pa.array([plain(j.response, RESPONSE) for j in jobs], to_arrow_type(RESPONSE))]
    return pa.RecordBatch.from_arrays(columns, ["request_id", "response"])


def response_type(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("request_id", kind), T.StructField("response", RESPONSE)])


def fetch(requests: DataFrame, transport: Transport | None = None, label: str = "responses", tasks: int | None = None) -> DataFrame:
    """request_id and response of every row of requests (request_id, request struct), fetched once and written.

    Requests are dealt by their hosts' lanes (``webloom.sources.lanes``); a task's threads share the transport. Requests that aren't
    idempotent are refused here, since a lost task is run again; ``send`` logs them.
    """
    kind, used = requests.schema["request_id"].dataType, transport or Refused()

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in batches(answered(jobs_of(rows), tries(used, NOT_IDEMPOTENT))):
            yield response_batch(done, kind)

    return written(dealt(requests, tasks).mapInArrow(work, response_type(kind)), label)
