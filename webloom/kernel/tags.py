"""Finding tags and attributes in markup as it is found on the web, without building a tree."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

from webloom.kernel.text import BLANK, decode_entities

#: Up to the end of a tag: ``>`` outside quotes.
_REST = re.compile(r"""((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(
    rf"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:[{BLANK}]*=[{BLANK}]*(?:"([^"]*)"|'([^']*)'|([^{BLANK}>"'`]+))|(?=[{BLANK}/]|\Z))"""
)
_SLASH = re.compile(rf"/[{BLANK}]*\Z")


class Tag(NamedTuple):
    attributes: str
    start: int
    content: int
    self_closing: bool


@cache
def _opener(name: str) -> re.Pattern[str]:
    return re.compile(rf"<{name}(?![A-Za-z0-9_])", re.I | re.A)


@cache
def _any_of(names: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile(rf"<(/[{BLANK}]*)?({'|'.join(names)})(?![A-Za-z0-9_])", re.I | re.A)


_CLOSED = re.compile(rf"[{BLANK}]*>")


def parse_attributes(s: str) -> dict[str, str]:
    """Attribute values by lower-case name; of equal names the last counts."""
    found = {}
    for m in _ATTRIBUTE.finditer(s):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        found[m[1].lower()] = decode_entities(value)
    return found


def _tag_at(html: str, m: re.Match[str]) -> Tag | None:
    rest = _REST.match(html, m.end())
    if rest is None:
        return None
    inside = rest[1]
    # A slash in quotes is followed by the closing quote, so the last character tells. A closing slash is no part of a value.
    return Tag(_SLASH.sub("", inside), m.start(), rest.end(), inside.endswith("/"))


def find_tags(html: str, name: str) -> Iterator[Tag]:
    """Opening tags of a name, up to one that never ends. Comments and scripts are not told apart."""
    at = 0
    while (m := _opener(name).search(html, at)) and (tag := _tag_at(html, m)):
        yield tag
        at = tag.content


class Span:
    """An opening tag and the element that it begins. ``content`` is None if the tag never ends, ``end`` if the element is never closed."""

    __slots__ = ("after", "content", "end", "html", "inside", "self_closing", "start")

    def __init__(self, html: str, start: int, inside: int, content: int | None) -> None:
        self.html, self.start, self.inside, self.content = html, start, inside, content
        self.self_closing = content is not None and html[content - 2] == "/" and content - 2 >= inside
        self.end, self.after = (content, content) if self.self_closing else (None, None)

    @property
    def attributes(self) -> str:
        return _SLASH.sub("", self.html[self.inside : self.content - 1])

    @property
    def text(self) -> str:
        return self.html[self.content : self.end]


def spans(html: str, names: tuple[str, ...]) -> dict[str, list[Span]]:
    """The opening tags of each name in order, with where their elements end: one scan of the document, a stack for each name.

    Names don't see each other: a tag of one name may begin within the attributes of another's.
    """
    found: dict[str, list[Span]] = {n: [] for n in names}
    waiting: dict[str, list[Span]] = {n: [] for n in names}
    resume = dict.fromkeys(names, 0)
    last = html.rfind(">")
    for m in _any_of(names).finditer(html):
        name, at = m[2].lower(), m.start()
        if at < resume[name]:
            continue
        if m[1]:
            closed = _CLOSED.match(html, m.end())
            if closed:
                resume[name] = closed.end()
                if waiting[name]:
                    element = waiting[name].pop()
                    element.end, element.after = at, closed.end()
            continue
        rest = _REST.match(html, m.end()) if last >= m.end() else None
        span = Span(html, at, m.end(), rest.end() if rest else None)
        found[name].append(span)
        resume[name] = m.end() if rest is None else span.content
        if rest and not span.self_closing:
            waiting[name].append(span)
    return found


def outermost(found: list[Span]) -> Iterator[Span]:
    """The elements that lie in no other of the same name, up to one that is never closed."""
    at = 0
    for span in found:
        if span.start >= at:
            if span.end is None:
                return
            yield span
            at = span.after


def balanced_contents(html: str, name: str) -> Iterator[tuple[Tag, str]]:
    """Outermost elements of a name with what they hold, up to one that is never closed."""
    for span in outermost(spans(html, (name,))[name]):
        yield Tag(span.attributes, span.start, span.content, span.self_closing), span.text


def first_balanced_where(html: str, name: str, fits: Callable[[dict[str, str]], bool]) -> str | None:
    """What the first outermost element holds whose attributes fit. Raises ValueError if the name is none of an element."""
    if not re.fullmatch("[A-Za-z][A-Za-z0-9-]*", name):
        raise ValueError(f"{name} is no name of an element")
    name = name.lower()
    return next((inside for tag, inside in balanced_contents(html, name) if fits(parse_attributes(tag.attributes))), None)
