"""URLs by the living standard: parsing, resolving, serialising."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace
from functools import lru_cache

#: Schemes with a host by rule, and their default ports.
SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
#: What is percent-encoded in each part, besides control and non-ASCII characters.
IN_FRAGMENT = ' "<>`'
IN_QUERY = ' "#<>'
IN_SPECIAL_QUERY = IN_QUERY + "'"
IN_PATH = IN_QUERY + "?^`{}"
IN_USER = IN_PATH + "/:;=@[\\]|"
_FORBIDDEN_HOST = set("\0\t\n\r #/:<>?@[\\]^|")
_FORBIDDEN_DOMAIN = _FORBIDDEN_HOST | set(map(chr, range(0x20))) | {"%", "\x7f"}
_UNCHANGED = re.compile(r"[A-Za-z0-9._~-]*")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")


class UrlError(ValueError):
    """The string is not a URL."""


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: tuple[str, ...] | str = ()
    query: str | None = None
    fragment: str | None = None

    @property
    def netloc(self) -> str:
        """Host and, unless it is the scheme's own, port."""
        return (self.host or "") + (f":{self.port}" if self.port is not None else "")

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.netloc}" if self.scheme in SPECIAL and self.scheme != "file" else "null"

    @property
    def pathname(self) -> str:
        return self.path if isinstance(self.path, str) else "".join("/" + p for p in self.path)

    @property
    def search(self) -> str:
        return f"?{self.query}" if self.query else ""

    def __str__(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            user = self.user + (":" + self.password if self.password else "")
            out += "//" + (user + "@" if user else "") + self.netloc
        elif not isinstance(self.path, str) and len(self.path) > 1 and not self.path[0]:
            out += "/."
        out += self.pathname
        return out + ("" if self.query is None else "?" + self.query) + ("" if self.fragment is None else "#" + self.fragment)


def encoded(s: str, also: str) -> str:
    if _UNCHANGED.fullmatch(s):
        return s
    return "".join(c if "\x20" <= c <= "\x7e" and c not in also else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in s)


def _ipv4_part(s: str) -> int | None:
    try:
        if s[:2] in ("0x", "0X"):
            return int(s[2:] or "0", 16) if re.fullmatch("[0-9a-fA-F]*", s[2:]) else None
        if len(s) > 1 and s[0] == "0":
            return int(s, 8) if re.fullmatch("[0-7]+", s) else None
        return int(s) if re.fullmatch("[0-9]{1,40}", s) else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """A host that ends in a number, as a dotted address; None if it doesn't, UrlError if it is none."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not (parts[-1] and (parts[-1].isdigit() and parts[-1].isascii() or re.fullmatch("0[xX][0-9a-fA-F]*", parts[-1]))):
        return None
    numbers = [_ipv4_part(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise UrlError("not an IPv4 address")
    value = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _ipv6(s: str) -> str:
    try:
        if "%" in s:
            raise ValueError
        raw = ipaddress.IPv6Address(s).packed
    except ValueError as e:
        raise UrlError("not an IPv6 address") from e
    groups = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, 16, 2)]
    # Where the longest run of zeros begins; of equal ones the first.
    runs = [(len(m.group()), m.start()) for m in re.finditer("0+", "".join("0" if g == 0 else "x" for g in groups))]
    n, start = max(runs, key=lambda r: (r[0], -r[1]), default=(0, 0))
    text = [f"{g:x}" for g in groups]
    if n < 2:
        return f"[{':'.join(text)}]"
    return f"[{':'.join(text[:start])}::{':'.join(text[start + n :])}]"


@lru_cache(4096)
def parse_host(s: str, special: bool) -> str:
    if s.startswith("["):
        if not s.endswith("]"):
            raise UrlError("an address that isn't closed")
        return _ipv6(s[1:-1])
    if not special:
        if any(c in _FORBIDDEN_HOST for c in s):
            raise UrlError("a character that no host has")
        return encoded(s, "")
    try:
        raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), s.encode("utf-8", "replace")).decode("utf-8", "replace")
        if raw.isascii():
            host = raw.lower()
        else:
            host = ".".join(p.encode("idna").decode("ascii") if p and not p.isascii() else p.lower() for p in re.split("[.。．｡]", raw))
    except UnicodeError as e:
        raise UrlError("not a domain") from e
    if not host or any(c in _FORBIDDEN_DOMAIN for c in host):
        raise UrlError("not a domain")
    return _ipv4(host) or host


def _dotted(segment: str) -> int:
    """1 for ``.``, 2 for ``..``, in any spelling, else 0."""
    s = re.sub("%2e", ".", segment, flags=re.I)
    return {".": 1, "..": 2}.get(s, 0)


def _is_drive(s: str) -> bool:
    return bool(re.fullmatch("[A-Za-z][:|]", s))


def _segments(text: str, special: bool, base: tuple[str, ...], file: bool) -> tuple[str, ...]:
    """Path segments of a text without its leading slash, behind those of base."""
    path = list(base)
    parts = re.split(r"[/\\]" if special else "/", text)
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        dots = _dotted(part)
        if dots == 2:
            if path and not (file and len(path) == 1 and re.fullmatch("[A-Za-z]:", path[0])):
                path.pop()
            path += [""] if last else []
        elif dots == 1:
            path += [""] if last else []
        else:
            if file and not path and _is_drive(part):
                part = part[0] + ":"
            path.append(encoded(part, IN_PATH))
    return tuple(path)


def parse(text: str, base: Url | None = None) -> Url:
    """The URL that a string means, relative to base if there is one. Raises UrlError."""
    s = re.sub("[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    s, has_fragment, fragment = s.partition("#")
    tail = {"fragment": encoded(fragment, IN_FRAGMENT) if has_fragment else None}
    m = _SCHEME.match(s)
    if m:
        scheme, rest = m[1].lower(), s[m.end() :]
        special = scheme in SPECIAL
        if special and base and base.scheme == scheme and scheme != "file" and not re.match(r"[/\\]{2}", rest):
            return _relative(rest, base, tail)
        if scheme == "file":
            return _file(rest, base if base and base.scheme == "file" else None, tail)
        if special:
            return _with_authority(scheme, re.sub(r"^[/\\]+", "", rest), tail)
        if rest.startswith("//"):
            return _with_authority(scheme, rest[2:], tail)
        path, has_query, query = rest.partition("?")
        tail["query"] = encoded(query, IN_QUERY) if has_query else None
        if path.startswith("/"):
            return Url(scheme, path=_segments(path[1:], False, (), False), **tail)
        return Url(scheme, path=encoded(path, ""), **tail)
    if base is None:
        raise UrlError("relative, without a base")
    if isinstance(base.path, str):
        if s or not has_fragment:
            raise UrlError("the base can't have relative URLs")
        return replace(base, **tail)
    return _file(s, base, tail) if base.scheme == "file" else _relative(s, base, tail)


def _query(scheme: str, rest: str, tail: dict) -> str:
    """What stands before the query, which goes to tail."""
    path, has_query, query = rest.partition("?")
    tail["query"] = encoded(query, IN_SPECIAL_QUERY if scheme in SPECIAL else IN_QUERY) if has_query else None
    return path


def _relative(s: str, base: Url, tail: dict) -> Url:
    special = base.scheme in SPECIAL
    slashes = r"[/\\]" if special else "/"
    if re.match(slashes + "{2}", s):
        return _with_authority(base.scheme, re.sub(r"^[/\\]+", "", s) if special else s[2:], tail)
    path = _query(base.scheme, s, tail)
    if re.match(slashes, path):
        return replace(base, path=_segments(path[1:], special, (), False), **tail)
    if not path:
        if tail["query"] is None:
            tail["query"] = base.query
        return replace(base, **tail)
    return replace(base, path=_segments(path, special, base.path[:-1], False), **tail)


def _with_authority(scheme: str, rest: str, tail: dict) -> Url:
    special = scheme in SPECIAL
    end = re.search(r"[/?\\]" if special else "[/?]", rest)
    authority, rest = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    user, at, host = authority.rpartition("@")
    if at and not host:
        raise UrlError("no host")
    name, _, password = user.partition(":")
    m = re.fullmatch(r"(\[[^\]]*\]?|[^:]*)(?::([0-9]*))?", host)
    if not m:
        raise UrlError("not a port")
    if special and not m[1]:
        raise UrlError("no host")
    port = int(m[2]) if m[2] else None
    if port is not None and port > 65535:
        raise UrlError("not a port")
    parsed = parse_host(m[1], special) if m[1] else ""
    path = _query(scheme, rest, tail)
    segments = _segments(path[1:], special, (), False) if path else (("",) if special else ())
    return Url(scheme, encoded(name, IN_USER), encoded(password, IN_USER), parsed, None if port == SPECIAL.get(scheme, -1) else port, segments, **tail)


def _file(s: str, base: Url | None, tail: dict) -> Url:
    m = re.match(r"[/\\]{2}([^/\\?]*)", s)
    if m and not _is_drive(m[1]):
        host = parse_host(m[1], True) if m[1] else ""
        path = _query("file", s[m.end() :], tail)
        return Url("file", host="" if host == "localhost" else host, path=_segments(path[1:], True, (), True) if path else ("",), **tail)
    path = _query("file", s[2:] if m else s, tail)
    if m or re.match(r"[/\\]", path) or base is None:
        return Url("file", host=base.host if base and not m else "", path=_segments(re.sub(r"^[/\\]", "", path), True, (), True), **tail)
    if not path:
        return replace(base, query=base.query if tail["query"] is None else tail["query"], fragment=tail["fragment"])
    return replace(base, path=_segments(path, True, base.path[:-1], True), **tail)


@lru_cache(4096)
def _parsed(text: str) -> Url:
    return parse(text)


def parse_or_none(text: str | None) -> Url | None:
    try:
        return _parsed(text) if text is not None else None
    except UrlError:
        return None


def resolve(href: str, base: str | None) -> str | None:
    """The absolute URL of a reference; None if it isn't one."""
    try:
        return str(parse(href, parse_or_none(base)))
    except UrlError:
        return None
