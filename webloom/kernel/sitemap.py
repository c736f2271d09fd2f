"""Sitemaps and sitemap indexes, plain or gzipped."""

from __future__ import annotations

import codecs
import gzip
import io
import zlib
from collections.abc import Iterator
from typing import Any

from webloom.kernel.text import number_prefix, trim
from webloom.kernel.xml import Element, parse, pulled


class PayloadError(ValueError):
    """A compressed body that can't be read."""


#: Bytes that a packed body may unpack to; the sitemap protocol allows a quarter of it.
MOST_UNPACKED = 200 << 20


def decode_payload(body: bytes, most: int = MOST_UNPACKED) -> str:
    """The text of a body, which is unpacked if it is gzipped, up to a size; UTF-8 whatever its headers say."""
    if body[:2] == b"\x1f\x8b":
        try:
            with gzip.GzipFile(fileobj=io.BytesIO(body)) as packed:
                body = packed.read(most + 1)
        except (OSError, EOFError, zlib.error) as e:
            raise PayloadError(str(e)) from e
        if len(body) > most:
            raise PayloadError(f"unpacks to more than {most} bytes")
    return body.decode("utf-8-sig", "replace")


def _field(e: Element, name: str) -> str | None:
    child = e.only(name)
    return (trim(child.text) or None) if child is not None else None


def payload_chunks(body: bytes, most: int = MOST_UNPACKED, size: int = 1 << 16) -> Iterator[str]:
    """As decode_payload, piece by piece."""
    decoder = codecs.getincrementaldecoder("utf-8-sig")("replace")
    if body[:2] != b"\x1f\x8b":
        for a in range(0, len(body), size):
            yield decoder.decode(body[a : a + size])
        yield decoder.decode(b"", True)
        return
    n = 0
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(body)) as packed:
            while piece := packed.read1(size):
                n += len(piece)
                if n > most:
                    raise PayloadError(f"unpacks to more than {most} bytes")
                yield decoder.decode(piece)
    except (OSError, EOFError, zlib.error) as e:
        raise PayloadError(str(e)) from e
    yield decoder.decode(b"", True)


def _url(e: Element) -> dict[str, Any] | None:
    if not (loc := _field(e, "loc")):
        return None
    priority = _field(e, "priority")
    return {"loc": loc, "lastmod": _field(e, "lastmod"), "changefreq": _field(e, "changefreq"), "priority": number_prefix(priority) if priority else None}


def parse_sitemap(text: str) -> dict[str, list]:
    """urls (loc, lastmod, changefreq, priority) and child_sitemaps."""
    document = parse(text)
    urls = [u for group in document.all("urlset")[:1] for e in group.all("url") if (u := _url(e))]
    children = [loc for group in document.all("sitemapindex")[:1] for e in group.all("sitemap") if (loc := _field(e, "loc"))]
    return {"urls": urls, "child_sitemaps": children}


def sitemap_entries(chunks: Iterator[str]) -> Iterator[tuple[bool, dict[str, Any]]]:
    """(whether it is a child sitemap, loc, lastmod, changefreq, priority) of each entry, as it is read."""
    for path, e in pulled(chunks, (("urlset", "url"), ("sitemapindex", "sitemap"))):
        if path[0] == "urlset":
            if u := _url(e):
                yield False, u
        elif loc := _field(e, "loc"):
            yield True, {"loc": loc, "lastmod": None, "changefreq": None, "priority": None}
