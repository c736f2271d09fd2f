"""RSS and Atom feeds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from webloom.kernel.text import trim
from webloom.kernel.xml import Element, parse, pulled

FIELDS = ("title", "link", "id", "published", "updated", "author", "summary", "content", "content_type")


def _value(e: Element | None) -> str | None:
    """An element's text; without any, its href."""
    if e is None:
        return None
    return trim(e.text) or trim(e.attributes.get("href", "")) or None


def _values(parent: Element, *names: str) -> str | None:
    """The first of the children that has a value."""
    return next((v for n in names if (v := _value(parent.only(n)))), None)


def _plain(e: Element) -> bool:
    """Whether an element is nothing but text."""
    return not e.attributes and not e.children


def _atom_link(parent: Element) -> str | None:
    other = None
    for e in parent.all("link"):
        if _plain(e):
            other = other if other is not None else trim(e.text)
            continue
        rel, href = e.attributes.get("rel", "").lower(), e.attributes.get("href")
        if not href:
            continue
        if rel in ("", "alternate"):
            return href
        if rel not in ("self", "hub", "enclosure") and other is None:
            other = href
    return other


def _atom_author(entry: Element) -> str | None:
    first = next(iter(entry.all("author")), None)
    if first is None:
        return None
    return _values(first, "name", "email") or _value(first)


def _rss_entry(item: Element) -> dict[str, Any]:
    value = lambda *names: _values(item, *names)
    return {
        "title": value("title"),
        "link": value("link"),
        "id": value("guid"),
        "published": value("pubDate"),
        "updated": None,
        "author": value("author", "dc:creator"),
        "summary": value("description"),
        "content": value("content:encoded"),
        "content_type": None,
        "categories": [v for c in item.all("category") if (v := _value(c))],
    }


def _atom_category(c: Element) -> str | None:
    return _value(c) if _plain(c) else trim(c.attributes.get("term", "")) or trim(c.attributes.get("label", "")) or None


def _atom_entry(entry: Element) -> dict[str, Any]:
    content = entry.only("content")
    return {
        "title": _values(entry, "title"),
        "link": _atom_link(entry),
        "id": _values(entry, "id"),
        "published": _values(entry, "published"),
        "updated": _values(entry, "updated"),
        "author": _atom_author(entry),
        "summary": _values(entry, "summary"),
        "content": _value(content),
        "content_type": content.attributes.get("type") or None if content is not None else None,
        "categories": [v for c in entry.all("category") if (v := _atom_category(c))],
    }


def parse_feed(text: str) -> dict[str, Any]:
    """kind (rss, atom, unknown), title, description, link, updated, entries."""
    document = parse(text, html_names=True)
    if rss := next(iter(document.all("rss")), None):
        channel = next(iter(rss.all("channel")), Element("channel", {}))
        head = {n: _values(channel, n) for n in ("title", "description", "link")}
        return {"kind": "rss", **head, "updated": _values(channel, "lastBuildDate", "pubDate"), "entries": [_rss_entry(i) for i in channel.all("item")]}
    if feed := next(iter(document.all("feed")), None):
        head = {"title": _values(feed, "title"), "description": _values(feed, "subtitle"), "link": _atom_link(feed), "updated": _values(feed, "updated")}
        return {"kind": "atom", **head, "entries": [_atom_entry(e) for e in feed.all("entry")]}
    return {"kind": "unknown", "title": None, "description": None, "link": None, "updated": None, "entries": []}


def feed_entries(chunks: Iterable[str]) -> Iterator[dict[str, Any]]:
    """The entries of a feed, each as it is read. In a document with both an RSS and an Atom root, those of the first."""
    first = None
    for path, e in pulled(chunks, (("rss", "channel", "item"), ("feed", "entry")), html_names=True):
        first = first or path[0]
        if path[0] == first:
            yield _rss_entry(e) if first == "rss" else _atom_entry(e)
